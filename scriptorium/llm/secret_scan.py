"""Secret scan by dictionary-primed compression novelty.

Base patterns find assignments, access keys and long hexadecimal runs. Beyond them, each
candidate (an unbroken run of key-like characters in the reach of a sensitive word) is priced by
its marginal compressed bytes: zstandard, primed with a dictionary of identifiers and the code around
the candidate, compresses the context with and without it. The dictionary has common identifiers and those
that weigh most in the documents themselves, counted over all of them. Ordinary identifiers repeat what the primer
holds and cost little; a random string costs its own entropy or more. That depends on its alphabet
(a random digit 0.42 bytes, a letter 0.59), so the price is held against that of the letters, digits and marks that the
candidate has, and no other rule decides.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import cut_lineage, free_of

KINDS = ("assign", "access", "hex", "novel")
CONTEXT_CHARS = 400  # of surrounding code on either side in the primer
SENSITIVE_CHARS = 64  # reach of a sensitive word before a candidate
SENSITIVE_AFTER = 32  # and after it
LEAST_CHARS = 16
LEAST_COST = 1.0  # marginal bytes over the entropy of as many random characters of the same alphabet
DICTIONARY_BYTES = 262_144  # of identifiers taken from the documents
IDENTIFIER = r"[A-Za-z_][A-Za-z_-]{3,31}"

# Identifiers and phrases that surround secrets in code (fixed values).
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret client_id "
    "authorization bearer credential credentials connection string username user account session "
    "cookie signature certificate public_key ssh-rsa https://www.example.com http://localhost:8080 "
    "github gitlab commit version checksum digest sha256 md5 uuid content-type application/json "
    "import export return function class const static final string integer boolean number "
    "config configuration environment variable production development default example sample "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000 xxxxxxxx"
)

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
_NAMED = re.compile(r"[^=]+=(?=[^=])")
_SENSITIVE = re.compile(r"(?ai)passw|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer|signature|client.?id|cookie|session")


def primed(identifiers: str = "") -> zstandard.ZstdCompressor:
    """A compressor primed with identifiers of the documents (most important last) and the common ones."""
    primer = zstandard.ZstdCompressionDict(f"{identifiers} {IDENTIFIERS}".strip().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False)


_compressor = primed()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns, in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def marginal_bytes(candidate: str, before: str, after: str, compressor: zstandard.ZstdCompressor = _compressor) -> int:
    """Compressed bytes that the candidate adds to its surroundings."""
    around = (before + "\n" + after + "\n").encode()
    return len(compressor.compress(around + candidate.encode())) - len(compressor.compress(around))


def random_bytes(run: str) -> float:
    """Bytes of entropy in as many random characters of the alphabet that a run is written in."""
    kinds = {c for c in run}
    digits = any("0" <= c <= "9" for c in kinds)
    low, high = any("a" <= c <= "z" for c in kinds), any("A" <= c <= "Z" for c in kinds)
    if digits and low != high and all(c in "0123456789abcdefABCDEF" for c in kinds):
        size = 16
    else:
        size = 10 * digits + 26 * low + 26 * high + sum(not c.isalnum() for c in kinds)
    return len(run) * math.log2(max(size, 2)) / 8


def corpus_identifiers(texts: DataFrame, size: int = DICTIONARY_BYTES) -> str:
    """The documents' identifiers of the greatest total length, most important last, as many as ``size`` bytes take.

    All identifiers of all documents (column ``text``) are counted, with partial counts before the shuffle; the
    dictionary has a fixed size, whatever the documents'.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(IDENTIFIER), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    counted = cut_lineage(counted.select("word", (F.col("n") * F.length("word")).alias("weight"), (F.length("word") + 1).alias("bytes")))
    # Weights by eighths of a doubling: from which one on the words fill the dictionary.
    step = F.floor(F.log2("weight") * 8).cast("int")
    held, least = 0, None
    for row in counted.groupBy(step.alias("step")).agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("step")).collect():  # 512 rows at most
        held, least = held + row.bytes, row.step
        if held >= size:
            break
    if least is None:
        return ""
    out, held = [], 0
    for row in counted.where(step >= least).orderBy(F.desc("weight"), "word").toLocalIterator():
        if held + row.bytes > size:
            break
        out.append(row.word)
        held += row.bytes
    return " ".join(reversed(out))


def value_start(run: str) -> int:
    """Where the value of an unspaced ``name=value`` run begins; 0 in any other run.

    The first ``=`` followed by anything but ``=`` divides it, so padding divides nothing.
    """
    m = _NAMED.match(run)
    return m.end() if m else 0


def novel_spans(text: str, base: list[tuple[int, int, str]], compressor: zstandard.ZstdCompressor = _compressor) -> list[tuple[int, int, str]]:
    """Incompressible runs near a sensitive word that no base span touches.

    The word may stand before the value, within its run or shortly after it. Other uses of
    a value are taken out of its context, or it would prime its own price; one that is
    reported is reported wherever it stands in the text.
    """
    places, found, priced = [], set(), set()
    free = free_of(base)
    for m in _CANDIDATE.finditer(text) if _SENSITIVE.search(text) else ():
        start = m.start() + value_start(m[0])
        run = text[start : m.end()]
        if len(run) < LEAST_CHARS or not free(start, m.end()):
            continue
        places.append((start, m.end(), run))
        if run in found or not _SENSITIVE.search(text, max(0, m.start() - SENSITIVE_CHARS), min(len(text), m.end() + SENSITIVE_AFTER)):
            continue
        reach = CONTEXT_CHARS + len(run)  # a use across the context's end is taken out whole
        before = text[max(0, start - reach) : start].replace(run, " ")[-CONTEXT_CHARS:]
        after = text[m.end() : m.end() + reach].replace(run, " ")[:CONTEXT_CHARS]
        if (run, before, after) in priced:
            continue
        priced.add((run, before, after))
        if marginal_bytes(run, before, after, compressor) >= LEAST_COST * random_bytes(run):
            found.add(run)
    return [(start, end, "novel") for start, end, run in places if run in found]


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_text(text: str, compressor: zstandard.ZstdCompressor = _compressor) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind in the order of ``KINDS``."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, compressor), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    Offsets are code points, ends exclusive. Null and empty texts have no spans (empty
    strings, the digest of an empty string). Every row gives one row, repeats and null ids
    too; an empty table gives an empty result; other columns are not looked at. The documents' own
    identifiers prime the prices (:func:`corpus_identifiers`).
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    identifiers = docs.sparkSession.sparkContext.broadcast(corpus_identifiers(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = primed(identifiers.value)
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            hashes, joined = [], []
            for text in batch.column(1):
                base, spans = scan_text(text.as_py(), compressor)
                for kind in KINDS:
                    counts[kind].append(sum(s[2] == kind for s in spans))
                hashes.append(hashlib.sha256(digest(base).encode()).hexdigest())
                joined.append(digest(spans))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(hashes), pa.array(joined), pa.array(counts["novel"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
