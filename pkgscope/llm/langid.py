"""Language identification by hierarchical discrimination.

A text becomes a vector of hashed letter trigrams (lower case, everything but
letters is one blank).  Linear support vector machines first decide the
language family, one against one; then, within the family, one-versus-one
machines separate the languages and their margins are summed.

The machines only choose between learned languages.  Whether a text is in one
of them at all is a question of its own: the mean log probability of its
trigrams under each learned language is compared with that of the language's
fitted texts, each left out of its own estimate.  A text further below all of
them than the fitted texts lie has its score lowered towards 0.

The machines are fitted on the driver on a bounded sample of the labelled
rows (``per_language`` distinct texts of each language, chosen by a hash), by
dual coordinate descent on the squared hinge loss.  All rows are predicted,
over their whole texts.

Defined cases: ``und`` with score 0 if the text is null or has no letter, or
if nothing was learned; repeated rows and null ids give a row each; an empty
table gives none; a language of no known family is a family of its own; other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgscope.llm import common

UND = "und"
DIMENSIONS = 1 << 12

#: ISO 639-1 codes by family; fixed values.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "af", "yi", "fo"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky"),
    "indic": ("hi", "ur", "bn", "pa", "mr", "gu", "ne", "si"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("ar", "he", "am", "mt"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "austronesian": ("id", "ms", "tl", "jv"),
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}

_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = regex.compile(rb"[A-Za-z]")
#: ASCII letters stay, other ASCII is one blank, bytes of longer code points stay.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or bool(raw) and not raw.isascii() and bool(_LETTER.search(raw.decode()))


def trigrams(raw: bytes, dimensions: int = DIMENSIONS, block: int = 1 << 20) -> np.ndarray:
    """Hashed trigram counts, by blocks of bounded size that overlap by two bytes."""
    low = raw.lower() if raw.isascii() else raw.decode().lower().encode()
    shift = 32 - (dimensions.bit_length() - 1)
    counts = np.zeros(dimensions, np.int64)
    for i in range(0, max(1, len(low) - 2), block):
        t = _FOLD[np.frombuffer(low[i:i + block + 2], np.uint8)]
        if len(t) < 3:
            t = np.concatenate([t, np.full(3 - len(t), 32, np.uint32)])
        code = (t[:-2] << np.uint32(16)) | (t[1:-1] << np.uint32(8)) | t[2:]
        code = code[(t[1:-1] != 32) | (t[:-2] != 32)]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(shift), minlength=dimensions)
    return counts


def unit(counts: np.ndarray) -> np.ndarray:
    """Unit vector of the square roots of counts."""
    x = np.sqrt(counts.astype(np.float64))
    return x / max(np.sqrt(x @ x), 1e-12)


def vector(raw: bytes, dimensions: int = DIMENSIONS, block: int = 1 << 20) -> np.ndarray:
    return unit(trigrams(raw, dimensions, block))


@dataclass
class Machines:
    """One-versus-one linear machines over some classes: rows of ``weights``
    decide ``pairs`` (positive margin: the first)."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean probability of each class over its pairs."""
        if len(self.classes) == 1:
            return np.ones(1)
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        total = np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, margins):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, 4 * m))))
            total[a] += p
            total[b] += 1 - p
        return total / (len(self.classes) - 1)


#: Neighbouring trigrams share two letters: a text of n has about n / 3 independent ones.
_OVERLAP = 3
#: Trigrams of one fitted text that count towards its language, so that no long text is the language.
_WEIGHT = 2000
#: Deviations below the fitted texts' median that are never held against a text, and the share of fitted texts (of the
#: lowest) that may lie lower still.
_DEVIATIONS, _LOWEST = 4.0, 0.01


@dataclass
class Likeness:
    """How far the trigrams of a text lie below those of the fitted texts of
    some languages.  One row per language, and one for texts that mix them:
    log probability of each trigram; median of the fitted texts' means,
    variance of one trigram, variance between texts, and the deviation from
    which on a text counts as unlike.  A trigram weighs the square root of its
    count, so that a text which repeats itself is not unlike its language."""

    languages: frozenset[str]
    logs: np.ndarray
    median: np.ndarray
    within: np.ndarray
    between: np.ndarray
    least: np.ndarray

    def of(self, counts: np.ndarray) -> float:
        """1 for a text like those of any fitted language, towards 0 the more it is unlike all of them."""
        weights = np.sqrt(counts)
        if not weights.any():
            return 1.0
        z = (self.logs @ (weights / weights.sum()) - self.median) / np.sqrt(self.within / _places(weights) + self.between)
        return math.exp(min(0.0, float((z - self.least).max())))


def _places(weights: np.ndarray) -> np.ndarray:
    """Number of equal weights whose mean varies as much as that of these."""
    return weights.sum(axis=-1) ** 2 / (weights ** 2).sum(axis=-1)


def _logs(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of trigrams; of unseen ones bounded, so that a few foreign words do not decide."""
    d = counts.shape[-1]
    return np.maximum(np.log((counts + 0.5) / (counts.sum() + 0.5 * d)), -math.log(d) - 3)


def likeness(x: np.ndarray, n: np.ndarray, labels: np.ndarray) -> Likeness | None:
    """Fitted on unit vectors and trigram counts of labelled texts.  A language
    with a single text has no row, as nothing says how its texts differ: what
    is predicted as that language is not judged.  None if all are so."""
    classes, own = np.unique(labels, return_inverse=True)
    _, first = np.unique(np.column_stack([own, x]), axis=0, return_index=True)  # copies say nothing of each other
    x, n, own = x[first], n[first], own[first]
    texts = np.bincount(own, minlength=len(classes))
    if texts.max(initial=0) < 2:
        return None
    weights = x / x.sum(axis=1, keepdims=True)
    places = _places(weights)
    share = weights * np.minimum(n, _WEIGHT)[:, None]
    totals = np.array([share[own == k].sum(axis=0) for k in range(len(classes))])
    least = totals.sum(axis=1).min()  # in a mixture all languages weigh alike
    mixed = (totals * (least / totals.sum(axis=1, keepdims=True))).sum(axis=0)
    left_out = lambda i: _logs(totals[own[i]] - share[i])
    means = np.array([weights[i] @ left_out(i) for i in range(len(x))])
    rows = [_row(_logs(t), t, means[own == k], places[own == k]) for k, t in enumerate(totals) if texts[k] > 1]
    if len(classes) > 1:
        rows.append(_row(_logs(mixed), mixed, weights @ _logs(mixed), places))
    return Likeness(frozenset(classes[texts > 1].tolist()), *map(np.array, zip(*rows)))


def _row(logs: np.ndarray, total: np.ndarray, means: np.ndarray, places: np.ndarray) -> tuple:
    q = total / total.sum()
    within = _OVERLAP * float(q @ (logs - q @ logs) ** 2)
    median = float(np.median(means))
    spread = (1.4826 * float(np.median(np.abs(means - median)))) ** 2
    between = max(spread - within / float(np.median(places)), 1e-4)
    z = (means - median) / np.sqrt(within / places + between)
    return logs, median, within, between, min(-_DEVIATIONS, float(np.quantile(z, _LOWEST, method="lower")))


@dataclass
class Model:
    families: Machines | None = None
    within: dict[str, Machines] = field(default_factory=dict)
    like: Likeness | None = None

    def predict(self, raw: bytes) -> tuple[str, float]:
        if self.families is None or not has_letter(raw):
            return UND, 0.0
        counts = trigrams(raw)
        x = unit(counts)
        f = self.families.scores(x)
        best = int(np.argmax(f))
        inner = self.within[self.families.classes[best]]
        p = inner.scores(x)
        lang = int(np.argmax(p))
        judged = self.like is not None and inner.classes[lang] in self.like.languages
        return inner.classes[lang], float(f[best] * p[lang]) * (self.like.of(counts) if judged else 1.0)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 20) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by dual
    coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    size = np.einsum("ij,ij->i", x, x) + 0.5 / c
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            grad = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - grad / size[i], 0.0)
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


def machines(x: np.ndarray, labels: np.ndarray) -> Machines:
    classes = sorted(set(labels.tolist()))
    pairs = list(combinations(range(len(classes)), 2))
    rows = []
    for a, b in pairs:
        pick = np.isin(labels, [classes[a], classes[b]])
        rows.append(svm(x[pick], np.where(labels[pick] == classes[a], 1.0, -1.0)))
    return Machines(classes, pairs, np.array(rows) if rows else np.zeros((0, x.shape[1] + 1)))


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 400, max_rows: int = 8000) -> DataFrame:
    """``lang, text``: up to ``per_language`` distinct texts of every language,
    fewer of each where all languages together would pass ``max_rows``.  Texts
    are chosen by a hash, so copies of a text are one, a language that is rare
    beside a much copied text keeps its rows, and the choice doesn't depend on
    how rows are partitioned.  More than ``max_rows`` languages are an error."""
    rows = common.pick(labelled, text=text_col, lang=lang_col).filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text", F.lit(11)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).limit(max_rows + 1).collect()}
    if len(counts) > max_rows:
        raise ValueError(f"more than {max_rows} languages: raise max_rows or clean the labels")
    if not counts:
        return rows.select("lang", "text").limit(0)
    each = min(per_language, max_rows // len(counts))
    # thinned first, with room for the error of the count and for chance, so that little text moves and each window stays small
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, (1.5 * each + 30) / max(n, 1)))])
    thin = rows.filter(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * float(1 << 30)).dropDuplicates(["lang", "h"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    return thin.withColumn("nth", nth).filter(F.col("nth") <= each).select("lang", "text")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 400, max_rows: int = 8000) -> Model:
    """Fit on the :func:`sample`: at most ``max_rows`` rows of 16 KB reach the driver."""
    drawn = sample(labelled, text_col, lang_col, per_language, max_rows)

    def features(batch: pa.RecordBatch):
        raw = common.text_bytes(batch)
        use = [i for i, t in enumerate(raw) if has_letter(t)]
        if use:
            counts = [trigrams(raw[i]) for i in use]
            x = [unit(c).astype(np.float32).tobytes() for c in counts]
            n = [int(c.sum()) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(use)), pa.array(x, pa.binary()), pa.array(n, pa.int64())], names=["lang", "x", "n"])

    got = common.map_batches(drawn, features, "lang string, x binary, n bigint").collect()
    if not got:
        return Model()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # the fit does not depend on the order of arrival
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64)
    langs = np.array([r["lang"] for r in got])
    families = np.array([family_of(v) for v in langs])
    return Model(machines(x, families), {f: machines(x[families == f], langs[families == f]) for f in sorted(set(families.tolist()))},
                 likeness(x, np.array([r["n"] for r in got]), langs))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few weight vectors of fixed length

    def run(batch: pa.RecordBatch):
        lang, score = zip(*map(sent.value.predict, common.text_bytes(batch)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return common.map_batches(common.pick(docs, id=id_col, text=text_col), run, f"id {kind}, lang_pred string, score double")


def fold(id_col):
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(id_col.cast("string")) % 3


def keep_known(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_score: float = 0.2, **fit_options) -> DataFrame:
    """The rows of ``docs`` in a language that was learned from its labelled
    rows: those predicted ``und`` or below ``min_score`` go.  The machines alone
    never score below 0.25; a text unlike every learned language does, see
    :class:`Likeness`.  All columns stay."""
    model = fit(docs, text_col, lang_col, **fit_options)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        keep = [lang != UND and score >= min_score for lang, score in map(sent.value.predict, common.text_bytes(batch, text_col))]
        yield batch.filter(pa.array(keep, pa.bool_()))

    return common.map_batches(docs, run, docs.schema)
