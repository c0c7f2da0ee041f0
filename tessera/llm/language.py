"""Language ID by Bayesian evidence fusion.

Evidence for each document: its text (byte trigrams, one model for each label, fitted on a bounded number of
its rows), the declared markup language, the address suffix, and its host. Priors of hosts come from the corpus itself: the
text posteriors of all documents are summed by host, a host's sums are smoothed by its suffix's, those by all
documents'. Logarithms of likelihoods and priors add up.

Text likelihoods of long texts would drown all else and are not independent from byte to byte: the mean over the text
counts as ``WEIGHT`` trigrams, fewer if the text has fewer. A text without letters has no language and is rejected, and
so is one whose best language stays under ``LEAST`` or that a model of evenly spread bytes explains better than every
language. The latter says nothing of a text whose declared language has no model.

Tables: ``of_documents`` has text, declared language and source (in the place of the host); ``of_pages`` has the main text
of web pages, the language that the markup declares, and the host and suffix of the address.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html
from .common import partitions, prepare, row_hashes, stored, table, tidy

#: Rows of a label that its text model is fitted on, about; of a label with fewer, all. All else covers all rows.
SAMPLE = 1000
#: Labels that a table may have: their models take 256 KB each on the driver and on executors. More are refused.
LANGUAGES = 512
#: Labels whose counts (512 KB each) a task holds before it hands them on.
HELD = 64
SLOTS = 1 << 16
WEIGHT = 64
LEAST = 0.5
#: Bytes of a row of scores without its two lists, and of a text, about: they set the number of files of scores.
ROW = 64
TEXT = 2048
#: Pseudo-documents that a level of the host hierarchy takes from the level above.
SMOOTH = 20.0


_LETTER = np.zeros(256, bool)
_LETTER[[0x20, 0x0A, *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def _slots(text: str) -> np.ndarray:
    """Slots of the trigrams that consist of letters and spaces: numbers and signs are of no language."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    b, own = raw.astype(np.uint32), _LETTER[raw]
    slots = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return slots[own[:-2] & own[1:-1] & own[2:]]


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of trigram slots: all labels, each from about ``sample`` rows.

    Rows are picked by a hash of id and text, so that repeated or null ids are picked one by one. Counts are summed on the executors; the driver gets one row a label. A label none of whose rows has a trigram of
    letters has no model. The model takes 256 KB a language; a table with more than ``LANGUAGES`` labels is refused.
    """
    prepare(docs.sparkSession)
    labelled = docs.filter("declared IS NOT NULL AND text IS NOT NULL AND declared <> ''")
    share = F.least(F.lit(1.0), sample / F.count(F.lit(1))) * (1 << 30)
    shares = stored(labelled.groupBy("declared").agg(share.cast("long").alias("below")), "labels")  # one row a label
    if (n := shares.count()) > LANGUAGES:
        raise ValueError(f"{n} languages are declared, more than {LANGUAGES}: are these languages?")
    picked = labelled.select("doc_id", "declared", "text").join(F.broadcast(shares), "declared")
    picked = picked.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) <= F.col("below"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([own.astype("<i8").tobytes()])], ["declared", "body"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column("declared").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in sums and len(sums) == HELD:
                    yield from flush()
                own = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                own += np.bincount(_slots(text), minlength=SLOTS)
        yield from flush()

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<i8") for b in rows.column("body").to_pylist())
        return pa.Table.from_arrays([rows.column("declared")[:1], pa.array([total.tobytes()])], ["declared", "body"])

    kind = "declared string, body binary"
    found = picked.select("declared", "text").mapInArrow(count, kind).groupBy("declared").applyInArrow(add, kind)
    sums = {r.declared: np.frombuffer(r.body, "<i8") for r in found.collect()}
    langs = sorted(x for x in sums if sums[x].any())
    counts = np.array([sums[x] for x in langs], float).reshape(len(langs), SLOTS) + 0.05
    return langs, np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)


def scores(docs: DataFrame, langs: list[str], model: np.ndarray, *keep: str) -> DataFrame:
    """``doc_id``, BIGINT columns ``keep``, ``declared, suffix, host, letters, even``, ``ll``: the tempered log likelihood of the whole text by language,
    and ``post``: the posterior of the text alone, zeros if it has no letters.

    ``even`` tells that evenly spread bytes explain the text better than any language.
    """
    prepare(docs.sparkSession)
    n, names = len(langs), ["doc_id", *keep, "declared", "suffix", "host"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flat = -np.log(256.0) * 3 + np.log(256.0)  # a byte after two known ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, even, ll = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                slots = _slots(text)
                mean = np.zeros(n)
                if len(slots) and n:
                    step = max(256, 65536 * 4 // n)
                    mean = sum(shared.value[slots[k : k + step]].sum(0, dtype=float) for k in range(0, len(slots), step)) / len(slots)
                letters.append(any(map(str.isalpha, text)))
                even.append(bool(n and len(slots) and mean.max() < flat))
                ll.append(mean * min(WEIGHT, len(slots)))
            post = _normal(np.array(ll).reshape(-1, n)) * np.array(letters)[:, None]
            own = [batch.column(c) for c in names]
            own += [pa.array(letters, pa.bool_()), pa.array(even, pa.bool_()), *(pa.array(list(x), pa.list_(pa.float64())) for x in (ll, post))]
            yield pa.RecordBatch.from_arrays(own, [*names, "letters", "even", "ll", "post"])
        tidy()

    kept = "".join(f"{k} long, " for k in keep)
    schema = f"doc_id long, {kept}declared string, suffix string, host string, letters boolean, even boolean, ll array<double>, post array<double>"
    return docs.select(*names, "text").mapInArrow(run, schema)


def _normal(logs: np.ndarray) -> np.ndarray:
    parts = np.exp(logs - logs.max(1, keepdims=True)) if len(logs) else logs
    return parts / parts.sum(1, keepdims=True)


def identify(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, lang, confidence, kept`` for each row of ``doc_id, text, declared, suffix, host`` (the last three may be null).

    BIGINT columns ``keep`` are passed through. Null evidence does not count. Null and empty texts have no language: lang is null, confidence 0, and they are rejected.
    """
    langs, model = fit(docs)
    if not langs:
        return docs.select("doc_id", *keep, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    n = len(langs)
    # scores are small beside their texts: as many files as their share of the bytes, not one for each task that reads texts
    files = math.ceil(partitions(docs.sparkSession) * min(1.0, (2 * 8 * n + ROW) / TEXT))
    scored = stored(scores(docs, langs, model, *keep).repartition(files), "scores")
    sums = F.array(*[F.coalesce(F.sum(F.col("post")[k]), F.lit(0.0)) for k in range(n)])
    # bounded: one row in all, and one for each language that may be declared
    total = scored.agg(sums.alias("p"), F.count("suffix").alias("suffixes")).first()
    whole = np.array(total.p)
    base = (whole + 1.0) / (whole.sum() + n)
    place = {x: k for k, x in enumerate(langs)}
    said = np.zeros((n, n))
    for r in scored.filter("declared IS NOT NULL").groupBy("declared").agg(sums.alias("p")).collect():
        if r.declared in place:
            said[place[r.declared]] = r.p
    heard = np.vstack([np.log((said + 0.5) / (said.sum(0) + 0.5 * n)), np.zeros(n)])  # the last row: nothing said
    hosts = scored.filter("host IS NOT NULL").groupBy(F.col("host").alias("h_host"), F.col("suffix").alias("h_suffix")).agg(sums.alias("h"))
    hosts = stored(hosts, "hosts")
    # few hosts are broadcast; of many, both sides are dealt by exchanges that AQE may split, for a host or suffix with very many rows
    found = scored.join(hosts, (scored["host"] == hosts["h_host"]) & scored["suffix"].eqNullSafe(hosts["h_suffix"]), "left")
    if total.suffixes:
        suffixes = stored(scored.filter("suffix IS NOT NULL").groupBy(F.col("suffix").alias("s_suffix")).agg(sums.alias("s")), "suffixes")
        found = found.join(suffixes, found["suffix"] == suffixes["s_suffix"], "left")
    else:
        found = found.withColumn("s", F.lit(None).cast("array<double>"))

    def smoothed(lists: pa.ListArray, above: np.ndarray) -> np.ndarray:
        """Priors of rows with sums; of those without, what lies above."""
        out, has = above.copy(), lists.is_valid().to_numpy(zero_copy_only=False)
        own = lists.drop_null().flatten().to_numpy().reshape(-1, n)
        out[has] = (own + SMOOTH * above[has]) / (own.sum(1, keepdims=True) + SMOOTH)
        return out

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll = batch.column("ll").flatten().to_numpy().reshape(-1, n)
            prior = smoothed(batch.column("h"), smoothed(batch.column("s"), np.tile(base, (len(ll), 1))))
            declared = batch.column("declared").to_pylist()
            final = _normal(ll + np.log(prior) + heard[[place.get(d, n) for d in declared]])
            best = n - 1 - final[:, ::-1].argmax(1)  # of equals, the last
            p = final[np.arange(len(ll)), best]
            letters, even = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("letters", "even"))
            even = even & np.array([not d or d in place for d in declared], bool)
            own = [*map(batch.column, ("doc_id", *keep)), pa.array([langs[k] if is_text else None for k, is_text in zip(best, letters, strict=True)], pa.string())]
            own += [pa.array(np.where(letters, p, 0.0)), pa.array(letters & ~even & (p >= LEAST))]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", *keep, "lang", "confidence", "kept"])

    found = found.select("doc_id", *keep, "declared", "letters", "even", "ll", "h", "s")
    return found.mapInArrow(fuse, f"doc_id long, {''.join(f'{k} long, ' for k in keep)}lang string, confidence double, kept boolean")


def of_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """Evidence that ``documents`` hold: the declared language, and the source in the place of the host."""
    nothing = F.lit(None).cast("string").alias("suffix")
    return docs.select("doc_id", *keep, "text", F.col("lang").alias("declared"), nothing, F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence that web pages hold, with ``page_id`` as doc_id: main text, declared language, address suffix and host."""
    lang = F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*\slang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))
    blank = lambda c: F.when(c != "", c)
    read = html.extract(pages.select("page_id", "url", "html", blank(lang).alias("declared")), "declared")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    return read.select(F.col("page_id").alias("doc_id"), "text", "declared", blank(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"), blank(host).alias("host"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, confidence, kept`` of every row of ``documents``, from whole texts, declared languages and sources.

    Null and empty texts have no language and are not kept; nulls in other columns are no evidence; repeated rows and ids
    (null ones too) are judged each by its own text; an empty table gives no rows; other columns are not read.
    """
    return identify(of_documents(table(spark, sf_dir, "documents")))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, lang, confidence, kept`` of every row of ``pages``, from main texts, markup, hosts and address suffixes."""
    return identify(of_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("doc_id", "page_id")


def accepted(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that have a language; all columns unchanged, whatever their names. A null doc_id is an id like others.

    Rows are known again by doc_id and two hashes of what the decision rests on, so that repeated ids do not share a fate.
    """
    names = [f"_{uuid.uuid4().hex}" for _ in "12"]
    rows = docs.withColumns(dict(zip(names, row_hashes("text", "lang", "source"), strict=True)))
    judged = identify(of_documents(rows, *names), *names).filter("NOT kept")
    rejected = stored(judged.select(F.col("doc_id").alias("rejected_id"), *[F.col(n).alias(f"{n}r") for n in names]).distinct(), "rejected")
    same = rows["doc_id"].eqNullSafe(rejected["rejected_id"])
    for n in names:
        same = same & (rows[n] == rejected[f"{n}r"])
    return rows.join(rejected, same, "left_anti").drop(*names)
