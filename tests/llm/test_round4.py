"""Findings of round 3 on the training-data operators."""

from pyspark.sql import functions as F

from pkgscope.llm import chat, secrets


def test_identifiers_are_counted_in_all_texts(spark):
    """Five of 20,000 distinct texts hold the name, two more are copies of one of them."""
    name = F.when(F.col("id") % 4000 == 7, " customer_account_handle").otherwise("")
    texts = spark.range(20000).select(F.concat(F.lit("row "), "id", name).alias("text"))
    docs = texts.unionByName(spark.range(2).select(F.lit("row 7 customer_account_handle").alias("text")))
    assert "customer_account_handle" in secrets.learn(docs, least=5).identifiers.split()
    assert "customer_account_handle" not in secrets.learn(docs, least=6).identifiers.split()


def test_chat_text_is_the_same_on_both_sides_of_the_switch(spark):
    """Where whole prefixes stop being compared (F23): the built-in template gives the same text and spans."""
    turns = [("c", ("user", "assistant")[i % 2], rf"\### User: {i} </turn>" * (i % 5)) for i in range(400)]
    whole = "".join(chat.turn_template([t[1:]]) for t in turns)
    results = []
    for limit in (1, 500, 5000, 1 << 26):
        rows = list(chat.format_rows(iter(turns), chat.turn_template, 4, 1 << 10, whole_chars=limit))
        assert "".join(r[2] for r in rows) == whole
        results.append([(s["turn"], s["start"], s["end"], s["body_start"], s["body_end"]) for r in rows for s in r[3]])
    assert all(r == results[-1] for r in results)


def test_the_built_in_template_is_rendered_on_every_whole_prefix():
    """No prefix is left out, whatever the length of the conversation or of its text."""
    turns = [("c", ("user", "assistant")[i % 2], f"text {i}") for i in range(150)]
    seen = set()

    def watched(prefix):
        seen.add(len(prefix))
        return chat.turn_template(prefix)

    watched.__dict__.update(chat.turn_template.__dict__)  # with what it declares
    rows = list(chat.format_rows(iter(turns), watched, 32, 1 << 10, whole_chars=500))
    assert seen == set(range(151))
    assert "".join(r[2] for r in rows) == chat.turn_template([t[1:] for t in turns]) and rows[-1][4] is None
