"""Secret scans by dictionary-primed zstandard novelty.

Three plain patterns (assign, access, hex) give the base spans.  The method
then looks at every long string near a sensitive word: it compresses
the surrounding text with and without the string, both primed with a
dictionary of identifiers (common ones, and those counted in a sample of the
texts), and the difference is the string's marginal size.
A string that cost nearly its own length is new to the code around it and to
the dictionary: it is reported as kind ``novel``.  Near is within reach after
or before the word.  Each novel string extends the reach to the next one on
either side, across blanks, line ends and quotes, until a compressible string
ends it: so all lines of a key block are found.

Defined cases: a null text counts as empty; every row gives one row, repeated
rows and null ids included; an empty table gives none; only the id and text
columns are read.  Offsets are code points, end exclusive, over whole texts.
Strings without a digit may be words; these are also spelled by the
letter pairs of common words, and the smaller size counts.
The work grows with the text's length, also where sensitive words crowd it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, replace
from itertools import accumulate
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscope.llm import common

#: Base patterns; fixed values.  Only ASCII letters match in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

#: Cheap byte tests that must hold before a pattern can match at all.
_MAY_ASSIGN = re.compile(rb"passw|secret|token|api_?key")
_MAY_HEX = re.compile(rb"[0-9a-f]{16}")
_MAY_CONTEXT = re.compile(rb"pass(?:word|wd|phrase|code)|secret|token|api[_-]?key|credential|private[_ -]?key|access[_ -]?key"
                          rb"|auth(?:orization)?[\"']?[ ]*[:=]|bearer|signature")

#: Words after which a long string is a candidate.
CONTEXT = re.compile(r"pass(?:word|wd|phrase|code)|secret|token|api[_-]?key|credential|private[_ -]?key|access[_ -]?key"
                     r"|auth(?:orization)?[\"']?[ ]*[:=]|bearer|signature", re.I | re.A)
MIN_CANDIDATE = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}", re.A)

#: What may stand between two strings of one chain: blanks, line ends (the letter of a written one belongs to the next string), quotes.
BETWEEN = re.compile(r"""[\s"'\\,;>|#*]+""")

#: What every dictionary that primes the compressor begins with: names that code and
#: configuration around credentials usually contain.  :func:`learn` adds those of the texts at hand.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key public_key credential credentials client_id "
    "client_secret authorization bearer signature username user_name account config configuration settings environment "
    "ENVIRONMENT PASSWORD SECRET TOKEN API_KEY ACCESS_KEY AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY DATABASE_URL "
    "localhost example.com https:// http:// www. .com/ .org/ index.html import from return function const static final "
    "public private protected class string String boolean integer default example placeholder changeme your_password "
    "your_token your_secret_here xxxxxxxxxxxxxxxx 0000000000000000 1111111111111111 0123456789 0123456789abcdef "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ test_token test_password getPassword setPassword getToken "
    "setToken refresh_token access_token session_token session_id request response connection timeout version "
)

#: Words of several languages whose letter pairs say what a word costs.
WORDS = (
    "the of and to in that is was for with his they this have from one had by word but not what all were when your can said there use each "
    "which she how their will other about out many then them these some her would make like him into time has look two more write see "
    "number way could people than first water been call who now find long down day did get come made may part over new sound take only "
    "little work know place year live back give most very after thing our just name good sentence man think say great where help through "
    "much before line right too mean old any same tell boy follow came want show also around form three small set put end does another "
    "well large must big even such because turn here why ask went men read need land different home move try kind hand picture again "
    "change off play spell air away animal house point page letter mother answer found study still learn should world information "
    "administration configuration responsibility characteristically authentication international development department management "
    "available knowledge question following possible important everything language something business government application certificate "
    "der die und das ist nicht ein eine mit sich auf für den dem von werden auch nach wird bei einer zum haben oder über aus wenn nur kann "
    "noch diese durch schon mehr zwischen gesellschaft versicherung geschwindigkeit bundesverfassungsgericht wirtschaft entwicklung "
    "verantwortung unterschiedlich beziehungsweise schlüssel kennwort zugang benutzer "
    "le les des est une que qui dans pour pas sur avec plus son par sont tout mais nous vous leur comme aussi même entre faire être cette "
    "responsabilité gouvernement développement quelquefois malheureusement aujourd anticonstitutionnellement utilisateur "
    "el los las por con una para como pero sus más este cuando muy sin sobre también hasta hay donde quien desde todo nos durante todos "
    "desafortunadamente responsabilidades conocimiento desarrollo organización contraseña usuario "
    "il che di non per sono della nel alla questo anche essere quello gli delle sviluppo conoscenza utente "
    "não uma com mais foi ao ele das tem seu sua ou ser quando muito nos já eu também só pelo pela até isso senha usuário "
    "het een van en niet zijn aan voor met er maar om dan zou wat mijn verantwoordelijkheid gebruiker wachtwoord "
)


@dataclass(frozen=True)
class Novelty:
    """Parameters of the novelty measure."""

    reach: int = 48          # code points between a sensitive word and the candidate, or between two strings of a chain
    around: int = 256        # code points of surrounding text on each side
    min_ratio: float = 0.70  # marginal bytes per byte of the candidate
    chain_ratio: float = 0.65  # the same for a string next to a novel one: base64 among base64 costs 0.75, give or take 0.03
    level: int = 3
    identifiers: str = IDENTIFIERS
    words: str = WORDS


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Scanner:
    """Holds the primed compressor of one worker."""

    def __init__(self, params: Novelty = Novelty()):
        self.p = params
        primer = zstandard.ZstdCompressionDict(params.identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=params.level)
        self.cost = _pair_costs(f"{params.words} {params.identifiers}")
        self.compress = zstandard.ZstdCompressor(level=params.level, dict_data=primer, write_checksum=False, write_dict_id=False,
                                                 write_content_size=False).compress

    def marginal(self, before: str, candidate: str, after: str) -> int:
        """Bytes the candidate adds to its compressed surroundings."""
        return len(self.compress(f"{before}{candidate}{after}".encode())) - len(self.compress(f"{before}{after}".encode()))

    def alone(self, before: str, candidate: str, after: str) -> int:
        """The marginal size with the surroundings in the dictionary too.
        Short surroundings may hold too few new letters for a code of their
        own; a string that lifts them over that number makes them smaller, and
        with them its marginal size.  Here they cost next to nothing."""
        primer = zstandard.ZstdCompressionDict(f"{self.p.identifiers}{after}{before}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=self.p.level)  # else only every third place of the dictionary is found again
        compress = zstandard.ZstdCompressor(level=self.p.level, dict_data=primer, write_checksum=False, write_dict_id=False, write_content_size=False).compress
        left, right = before[-32:], after[:32]  # both in the dictionary
        return len(compress(f"{left}{candidate}{right}".encode())) - len(compress(f"{left}{right}".encode()))

    def spelled(self, string: str) -> float:
        """Bytes of a string without digits, spelled letter by letter as words
        are.  Zstandard alone takes no word that it has not seen, however
        plain, for less than its letters.  A capital within a word costs a bit
        for every letter before it that it cuts short, up to 5."""
        bits, last, run = 0.0, " ", 0  # run: letters of the same case up to here
        for c in string:
            low = c.lower()
            if not c.isalpha():
                bits, last, run = bits + (2 if last.isalpha() else 5), c, 0
            elif last.isalpha() and c.isupper() and last.islower():  # a new word
                bits, run = bits + self.cost[" " + low] + max(0, 5 - run), 1
            else:
                short = last.isupper() and c.islower() and run > 1  # the last capital begins a word, as in HTTPServer
                bits += self.cost[(last.lower() if last.isalpha() else " ") + low] + short
                run = run + 1 if last.isalpha() and (last.isupper() == c.isupper() or run == 1) else 1
            last = c
        return bits / 8

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """Places of the strings that begin within reach of a sensitive word.
        A run of string characters gives the strings from its first and from
        its last such place to its end, and those between sensitive words
        inside it; together they are at most three times as long as the run."""
        runs: dict[int, list[tuple[int, int]]] = {}  # end of the run -> (begin of the word, begin of the string)
        ends: list[int] = []  # of the runs met so far; a later word may begin before or inside some of them
        for word in CONTEXT.finditer(text):
            at, stop = word.end(), word.end() + self.p.reach
            while at <= stop:
                m = CANDIDATE.search(text, at, stop + MIN_CANDIDATE)  # sees every start up to stop
                if not m or m.start() > stop:
                    break
                a = m.start()
                if not ends or a >= ends[-1]:
                    ends.append(CANDIDATE.match(text, a).end())
                at = ends[bisect_right(ends, a)]
                places = runs.setdefault(at, [])
                if not places or a > places[-1][1]:
                    places.append((word.start(), a))
        found = set()
        for end, places in runs.items():
            found |= {(places[0][1], end), (places[-1][1], end)}
            found |= {(a, cut) for (_, a), (cut, _) in zip(places, places[1:]) if cut - a >= MIN_CANDIDATE}
        return sorted(found)

    def candidates_before(self, text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Places of the strings that end within reach before a sensitive word,
        and of the beginning of a run up to the first such word inside it.
        ``runs``: all runs of string characters."""
        ends = [b for _, b in runs]
        found, cut = set(), set()
        for word in CONTEXT.finditer(text):
            at = word.start()
            i = bisect_right(ends, at)  # the first run that ends behind the begin of the word
            if i < len(runs) and runs[i][0] < at and i not in cut:
                cut.add(i)
                if at - runs[i][0] >= MIN_CANDIDATE:
                    found.add((runs[i][0], at))
            while i and ends[i - 1] >= at - self.p.reach:
                i -= 1
                found.add(runs[i])
        return sorted(found)

    def novel_spans(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        starts = [a for _, a, _ in base]
        reached = list(accumulate((b for _, _, b in base), max))  # furthest end of the base spans so far
        runs = [m.span() for m in CANDIDATE.finditer(text)]
        near = {*self.candidates(text), *self.candidates_before(text, runs)}
        novel = {at for at in near if self._is_new(text, at, self.p.min_ratio)}
        novel |= self._chained(text, runs, novel)
        spans = []
        for a, b in sorted(novel):
            before = bisect_right(starts, a)
            inside = before and reached[before - 1] >= b
            if not inside:
                spans.append(("novel", a, b))
        return spans

    def _chained(self, text: str, runs: list[tuple[int, int]], novel: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """The runs that novel strings lead to, forwards and backwards; each run is measured once."""
        begins, found, verdict = [a for a, _ in runs], set(), {}
        for step in (1, -1):
            for a, b in sorted(novel):
                i = bisect_right(begins, a) - 1  # the run that holds the string
                if (b if step > 0 else a) != runs[i][step > 0]:
                    continue  # something else of the run stands between
                while 0 <= i + step < len(runs):
                    left, right = sorted((i, i + step))
                    gap = (runs[left][1], runs[right][0])
                    if gap[1] - gap[0] > self.p.reach or not BETWEEN.fullmatch(text, *gap):
                        break
                    i += step
                    if (i, step) in verdict or runs[i] in novel:
                        break  # was or will be followed from there
                    if i not in verdict:
                        verdict[i] = self._is_new(text, runs[i], self.p.chain_ratio, gap)
                    verdict[i, step] = True
                    if not verdict[i]:
                        break
                    found.add(runs[i])
        return found

    def _is_new(self, text: str, at: tuple[int, int], ratio: float, gap: tuple[int, int] | None = None) -> bool:
        """``gap``: the place between the string and the next of its chain,
        measured with the string; two gaps side by side would be new themselves."""
        a, b = at
        string = text[a:b]
        if not any(c.isdigit() for c in string) and self.spelled(string) < self.p.min_ratio * (b - a):
            return False  # words and names of words
        lo, hi = (min(a, gap[0]), max(b, gap[1])) if gap else at
        parts = text[max(0, lo - self.p.around):lo], text[lo:hi], text[hi:hi + self.p.around]
        least = ratio * (b - a)
        return self.marginal(*parts) >= least or lo == a and hi == b and self.alone(*parts) >= least

    def spans(self, text: str) -> tuple[list, list]:
        """(base spans, all spans) of one text, both by start, then kind."""
        base = base_spans(text)
        found = base + self.novel_spans(text, base)
        return base, sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))

    def spans_of(self, raw: bytes) -> tuple[list, list]:
        """As :meth:`spans`, for UTF-8 bytes; texts where no pattern can match are not decoded."""
        low = raw.lower()
        if _MAY_HEX.search(raw) or b"AKIA" in raw or _MAY_ASSIGN.search(low) or _MAY_CONTEXT.search(low):
            return self.spans(raw.decode())
        return [], []


def _pair_costs(words: str) -> dict[str, float]:
    """Bits of each letter after another one or after none (a blank), by the
    pairs of the words; a letter the words do not have there costs most."""
    pairs = Counter(x for w in re.findall("[a-z]+", words.lower()) for x in map("".join, zip(f" {w}", w)))
    firsts = Counter()
    for pair, n in pairs.items():
        firsts[pair[0]] += n
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: -log2((pairs[a + b] + 0.25) / (firsts[a] + 0.25 * 26)) for a in f" {letters}" for b in letters}


def learn(docs: DataFrame, text_col: str = "text", params: Novelty = Novelty(), entries: int = 400, least: int = 5) -> Novelty:
    """``params`` with the identifiers of the texts added to the dictionary:
    the ``entries`` that occur in most distinct texts, and in ``least`` of them
    or more.  Every text counts; copies of a text, told by its hash, count
    once.  They have no digits and are spelled like words, so no secret that
    is copied from text to text gets into the dictionary.  Only the entries
    reach the driver, and only names are shuffled."""
    names = F.array_join(F.array_distinct(F.expr("regexp_extract_all(text, '[A-Za-z_]{4,40}', 0)")), " ")  # one string: shuffled smaller than an array
    texts = common.pick(docs, text=text_col).filter("text IS NOT NULL").select(F.xxhash64("text", F.lit(13)).alias("h"), names.alias("names"))
    counted = texts.dropDuplicates(["h"]).filter("names <> ''").select(F.explode(F.split("names", " ")).alias("name")).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    found = [r["name"] for r in counted.orderBy(F.desc("n"), "name").limit(4 * entries).collect()]
    plain = Scanner(params)
    kept = [x for x in found if plain.spelled(x) < params.min_ratio * len(x)][:entries]
    return replace(params, identifiers=f"{' '.join(reversed(kept))} {params.identifiers}")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Novelty | None = None) -> DataFrame:
    """One row per document: ``id, base, spans`` with arrays of
    ``struct<kind, start, end>`` by start, then kind.  No text is shuffled.
    :func:`learn` gives ``params`` if there are none."""
    params = params or learn(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def scan(batch: pa.RecordBatch):
        scanner = _scanner(params)
        found = [scanner.spans_of(t) for t in common.text_bytes(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([as_rows(b) for b, _ in found], span_type), pa.array([as_rows(s) for _, s in found], span_type)],
            names=["id", "base", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return common.map_batches(common.pick(docs, id=id_col, text=text_col), scan, f"id {kind}, base {spans}, spans {spans}")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[REDACTED]",
           params: Novelty | None = None) -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark`` (overlapping
    spans by one mark) and the length column, if there is one, set anew for
    the texts that changed.  All rows and columns stay; null texts stay null.
    ``params`` as in :func:`find_secrets`."""
    params = params or learn(docs, text_col)
    names = docs.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def rewrite(batch: pa.RecordBatch):
        scanner = _scanner(params)
        raw = common.text_bytes(batch, text_col)
        changed = {}
        for i, t in enumerate(raw):
            _, spans = scanner.spans_of(t)
            if spans:
                changed[i] = _replace(t.decode(), spans, mark)
        if not changed:
            yield batch
            return
        columns = batch.columns
        old = columns[at].to_pylist()
        columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(old)], columns[at].type)
        if length_at is not None:
            sizes = columns[length_at].to_pylist()
            columns[length_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(sizes)], columns[length_at].type)
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return common.map_batches(docs, rewrite, docs.schema)


def _replace(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, done = [], 0
    for _, a, b in spans:
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


_held: dict[Novelty, Scanner] = {}


def _scanner(params: Novelty) -> Scanner:
    if params not in _held:
        _held[params] = Scanner(params)
    return _held[params]
