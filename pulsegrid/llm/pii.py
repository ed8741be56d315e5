"""Personal data: pattern spans, and information-theoretic sanitisation of the words around them.

Patterns find e-mail addresses, IPs, card and phone numbers (the base spans). Words within ``radius``
words of a base span are candidates to reveal it. The corpus tells how strongly: a word w and a
protected entity e (kind and value) that meet in n(w, e) windows disclose

    pmi(w, e) = log2( n(w, e) * N / (n(w) * n(e)) )     and     share(w, e) = n(w, e) / n(w)

with n(w) the word's count and N the number of words in the whole corpus, n(e) the words in e's
windows. Where both reach their thresholds with enough support (distinct windows texts, so copies
count once), the word is a "term" span wherever it stands in a document that holds the entity, to be removed like
the base spans; below the removal threshold for share it is generalised to its shape. Terms that meet an entity only
outside its windows are not judged. Terms and counts are folded by one function. Counts are sums over all documents:
words are counted per task, then by key; candidate rows are as many as the corpus has base spans times
the window. Nothing is gathered by entity or word: all are counts and joins on both.

Offsets are code points, end exclusive. Null text is empty: no spans. Equal and repeated rows each get
the same spans. Other columns are kept by ``sanitise`` and ignored by ``find_pii``. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import materialize, row_key, slices, table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest local part before an @ that a domain follows."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, (end := m.end())
            at = m.end() - 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_EDGE = ".,;:!?()[]{}\"'*#$%&"


def fold(word: str) -> str:
    """The term that a word stands for."""
    return word.strip(_EDGE).casefold()


def _words_before(text: str, end: int, n: int) -> list[tuple[int, int]]:
    """The last n words before end, whole ones however long: the stretch looked at doubles until it holds them."""
    reach = 64 * n
    while True:
        lo = max(0, end - reach)
        found = [m.span() for m in _WORD.finditer(text, lo, end)]
        if lo == 0 or len(found) > n:  # the first one may begin before lo
            return found[-n:] if n else []
        reach *= 2


def contexts(text: str, spans: list[tuple[str, int, int]], radius: int) -> list[tuple[str, int, int, str, str]]:
    """(term, start, end, entity, window hash) of the words near each span, outside all spans."""
    out: list[tuple[str, int, int, str, str]] = []
    for kind, a, b in spans:
        near = _words_before(text, a, radius) + [m.span() for m in islice(_WORD.finditer(text, b), radius)]
        window = hashlib.blake2b(text[near[0][0] if near else a : near[-1][1] if near else b].encode(), digest_size=8).hexdigest()
        for s, e in near:
            word = text[s:e]
            core = word.strip(_EDGE)
            s += word.find(core) if core else 0
            e = s + len(core)
            if core and not any(x < e and s < y for _, x, y in spans):
                out.append((fold(core), s, e, f"{kind}:{text[a:b].casefold()}", window))
    return out


def marked(text: str, base: list[tuple[int, int]], terms: dict[str, bool]) -> list[dict]:
    """s, e, remove of all words outside the base spans (by start) that stand for one of the terms."""
    out, at, end = [], 0, 0
    for m in _WORD.finditer(text):
        word = m[0]
        if (term := fold(word)) not in terms:
            continue
        core = word.strip(_EDGE)
        s = m.start() + word.find(core)
        e = s + len(core)
        while at < len(base) and base[at][0] < e:
            end = max(end, base[at][1])
            at += 1
        # the last base spans may begin before this word and end within it, or behind it
        if end <= s:
            out.append({"s": s, "e": e, "remove": terms[term]})
    return out


_OUT = "tag string, doc_id {id}, row binary, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<term:string,s:int,e:int,entity:string,window:string>>, entities array<string>, word string, n long"


def _scan(docs: DataFrame, radius: int, most_words: int) -> DataFrame:
    """Tagged rows: a "doc" row per document, and "word" rows with each task's counts."""
    kind = docs.schema["_id"].dataType.simpleString()
    near_type = pa.list_(pa.struct([("term", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("entity", pa.string()), ("window", pa.string())]))

    strings = pa.list_(pa.string())

    def counted(counts: Counter, id_type: pa.DataType) -> pa.RecordBatch:
        terms: Counter = Counter()
        for w, k in counts.items():
            terms[fold(w.decode())] += k
        n, none = len(terms), lambda t: pa.nulls(len(terms), t)
        return pa.RecordBatch.from_arrays(
            [pa.array(["word"] * n, pa.string()), none(id_type), none(pa.binary()), *[none(pa.int64())] * 4, none(pa.string()), none(near_type), none(strings), pa.array(list(terms), pa.string()), pa.array(list(terms.values()), pa.int64())], names=names
        )

    names = [x.split()[0] for x in _OUT.format(id="x").replace("array<struct<term:string,s:int,e:int,entity:string,window:string>>", "x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        id_type = pa.int64()
        for batch in slices(batches):
            id_type = batch.column(0).type
            found = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                counts.update(text.encode().lower().split())
                near = [dict(zip(("term", "s", "e", "entity", "window"), x, strict=True)) for x in contexts(text, spans, radius)] if spans else []
                kinds = [k for k, _, _ in spans]
                held = sorted({f"{k}:{text[a:b].casefold()}" for k, a, b in spans})
                found.append((*(kinds.count(k) for k in KINDS), span_text(spans), near, held))
            cols, n = list(zip(*found, strict=True)) or [()] * 7, len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * n, pa.string()), batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], near_type), pa.array(cols[6], strings), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names
            )
            if len(counts) > most_words:
                yield counted(counts, id_type)
                counts.clear()
        if counts:
            yield counted(counts, id_type)

    return docs.select("_id", "_text", row_key("_id", "_text").alias("_row")).mapInArrow(run, _OUT.format(id=kind))


def _mark(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows: _id, _text. terms: row, base, found (structs of term, remove). Per row of terms: row, and its spans as terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, base, found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                spans = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in base.split(",")))
                out.append(marked(text, spans, {t["term"]: t["remove"] for t in found}))
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("remove", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["row", "terms"])

    texts = rows.select(row_key("_id", "_text").alias("row"), "_text").join(terms.select("row"), "row", "left_semi").dropDuplicates(["row"])
    return texts.join(terms, "row").select("row", "_text", "base", "found").mapInArrow(run, "row binary, terms array<struct<s:int,e:int,remove:boolean>>").filter("size(terms) > 0")


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 5,
    min_pmi: float = 8.0,
    min_share: float = 0.5,
    support: int = 3,
    remove_share: float = 0.8,
    most_words: int = 300_000,
) -> DataFrame:
    """Per row: doc_id, row (key of id and text), counts by kind, base (its spans), terms: array of (s, e, remove)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    seen = materialize(_scan(rows, radius, most_words))
    told = seen.filter("tag = 'doc'")
    near = told.filter("size(near) > 0").select("row", F.explode("near").alias("x")).select("row", "x.*").dropDuplicates(["row", "s", "e", "entity"])
    near = materialize(near)
    # copies of a window count once in the support
    pairs = near.groupBy("term", "entity", "window").agg(F.count(F.lit(1)).alias("k")).groupBy("term", "entity").agg(F.count(F.lit(1)).alias("windows"), F.sum("k").alias("n_te"))
    pairs = materialize(pairs.filter(F.col("windows") >= support))
    entities = materialize(near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")))
    words = seen.filter("tag = 'word'")
    total = words.agg(F.sum("n")).first()[0] or 1
    counts = words.select(F.col("word").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n_t"))
    wanted = pairs.select("term").distinct()
    counts = materialize(counts.join(wanted, "term"))
    n_t = F.greatest("n_t", "n_te")
    share = F.col("n_te") / n_t
    pmi = F.log2(F.col("n_te") * F.lit(float(total)) / (n_t * F.col("n_e")))
    strong = pairs.join(counts, "term").join(entities, "entity").filter((pmi >= min_pmi) & (share >= min_share))
    strong = materialize(strong.select("term", "entity", (share >= remove_share).alias("remove")))
    # of each text that holds a strong entity, all its terms, wherever they stand
    held = told.filter("size(entities) > 0").select("row", "base", "entities").dropDuplicates(["row"])
    terms = held.select("row", F.explode("entities").alias("entity")).join(strong, "entity").groupBy("row", "term").agg(F.max("remove").alias("remove"))
    terms = materialize(terms.groupBy("row").agg(F.collect_list(F.struct("term", "remove")).alias("found")).join(held.select("row", "base"), "row"))
    spans = materialize(_mark(rows, terms))
    return told.select("doc_id", "row", *[f"n_{k}" for k in KINDS], "base").join(spans, "row", "left")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with base spans replaced by their kind, and disclosing terms removed or generalised to their shape."""
    found = find_pii(docs, id_col, text_col, **how).select(F.col("row").alias("_key"), "base", "terms").dropDuplicates(["_key"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("_text"), row_key(docs[id_col], docs[text_col]).alias("_key"))
    joined = rows.join(materialize(found.filter("base <> '' or size(terms) > 0")), "_key", "left").select("_row", "_text", "base", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, base, terms in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if text and (base or terms):
                    cuts = [(int(a), int(b), f"<{k}>") for k, a, b in (x.split(":") for x in (base or "").split(",") if x)]
                    for t in terms or []:
                        word = text[t["s"] : t["e"]]
                        cuts.append((t["s"], t["e"], "" if t["remove"] else re.sub(r"\w", "x", word)))
                    out, at = [], 0
                    for a, b, put in sorted(cuts):
                        if a >= at:
                            out += [text[at:a], put]
                        at = max(at, b)
                    text = "".join([*out, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "_text"])

    clean = joined.mapInArrow(run, StructType([StructField("_row", StructType(docs.schema.fields)), StructField("_text", docs.schema[text_col].dataType)]))
    return clean.select(*[(F.col("_text") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    terms = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["s"].cast("string"), t["e"].cast("string"))), ",")
    base = F.when(F.col("base") != "", F.col("base"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", base, F.when(terms != "", terms)).alias("spans"))
