"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

Classes are the declared languages and noise. Text gives log P(byte trigrams | class): smoothed models trained on the
declared languages, and the uniform distribution for noise. The declared markup language and the address suffix give
P(value | class) from grouped counts of text-only decisions, one row a value, joined. The host gives a prior
smoothed in levels: host towards registered domain towards all rows, each level one grouped
aggregation; a row's own count is left out. The posterior is the normalised product; a usable language code as
declaration excludes noise. A row is rejected when its text holds no letters, whatever else is known, or
when noise is the most probable class.

Declared values that hold at least ``min_share`` of the rows have a model in every task (at most 1/min_share *
2^14 floats). All others, however rare, share one slot: their counts stay a table keyed by language and bucket,
which is joined with the rows that declare one of them, that their pooled model explains best, or that noise
explains better than every common language; a row's own counts are left out, and the best of them fills the slot.
Null or blank declarations, suffixes and hosts are no evidence. Null or empty texts have no text evidence and are
rejected. Tables without a declaration give no language; there only texts without letters are rejected. Repeated
rows and ids are rows of their own. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, keep_rows, keyed, own_columns, staged

BITS = 14
GROUP_BYTES = 1 << 20
#: Cells of a table of trigrams by classes that a task weighs at once.
CELLS = 1 << 21
#: Bytes of text after which more text adds no certainty: neighbours in a text are not independent.
ENOUGH = 200.0
#: Weight of the uniform distribution in each model: no trigram costs more than log(2^BITS / FLOOR), however large the corpus.
FLOOR = 0.1
#: The slot of the languages below ``min_share``.
RARE = "\0rare"
#: The class of texts that uniform noise explains best.
NOISE = "\0noise"
#: Characters that are not letters; a text of these alone has none.
NOT_LETTERS = b"\t\n\x0b\x0c\r !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"


def markup_language(html: Column) -> Column:
    """The language declared by the first ``html`` tag, however long, lower case, without region; null if none."""
    tag = F.regexp_extract(html, r"(?i)<html\b([^>]*+)", 1)
    found = F.lower(F.regexp_extract(tag, r"(?i)\slang\s*+=\s*+[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; only to weigh languages, not an extractor."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*+>|&[a-zA-Z#0-9]{1,10};", " ")


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def suffix_of(host: Column) -> Column:
    found = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    return F.when(found != "", found)


def _groups(texts: list[str | None]):
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram, start of each text's trigrams, their number); case and digits folded.

    A space stands before and after each text, so every text has at least one trigram."""
    flat = np.frombuffer(b"".join(b" " + t + b"  " for t in texts), dtype=np.uint8)
    b = _FOLD[flat]
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    mixed ^= mixed >> np.uint32(15)
    bucket = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    size = np.array([len(t) + 3 for t in texts])
    start = np.cumsum(size) - size
    return np.append(bucket, np.zeros(2, dtype=np.uint32)), start, size - 2


def summed(table: np.ndarray, bucket: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum over each text's trigrams of their rows of ``table``; memory is bounded however long a text is."""
    # the two trigrams that run into the next text meet a row of zeros
    where = bucket.astype(np.int64)
    where[np.concatenate((start + n, start + n + 1))] = len(table) - 1
    out = np.zeros((len(start), table.shape[1]))
    step = max(1 << 12, CELLS // table.shape[1])
    for a in range(0, len(where), step):
        b = min(len(where), a + step)
        first = np.searchsorted(start, a, side="right") - 1
        stop = np.searchsorted(start, b, side="left")
        cuts = np.maximum(start[first:stop], a) - a
        out[first:stop] += np.add.reduceat(table[where[a:b]], cuts, axis=0, dtype=np.float64)
    return out


def languages(declared: DataFrame, min_share: float) -> list[str]:
    """Declared values with at least ``min_share`` of the non-null rows, and ``RARE`` if there are others."""
    counts = declared.where(F.col("declared").isNotNull()).groupBy("declared").count()
    total = counts.agg(F.sum("count").alias("n")).first()["n"] or 0
    common = sorted(r["declared"] for r in counts.where(F.col("count") >= max(1, min_share * total)).collect())
    return common + [RARE] * (not counts.where(F.col("count") < max(1, min_share * total)).isEmpty())


def train(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """log P(trigram bucket | language) [buckets, languages], from all rows with a chosen declaration.

    Each task sums its rows first; the shuffle moves at most tasks * languages * 2^14 counts."""
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches):
        sums = np.zeros((len(langs), 1 << BITS), dtype=np.int64)
        for batch in batches:
            declared, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(declared):
                for group in _groups([t for t, d in zip(texts, declared) if d == lang]):
                    bucket, start, n = trigrams(group)
                    sums[place[lang]] += np.bincount(bucket, minlength=1 << BITS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums.ravel()[at])], names=["cell", "n"])

    counts = np.zeros(len(langs) << BITS)
    slot = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull(), F.lit(RARE))
    got = rows.select(slot.alias("declared"), "text").where(F.col("declared").isNotNull()).mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    counts = counts.reshape(len(langs), -1)
    share = (counts.sum(axis=0) + 1) / (counts.sum() + (1 << BITS))
    # each language backs off to all of them together
    model = (counts + 0.02 * (1 << BITS) * share) / (counts.sum(axis=1, keepdims=True) + 0.02 * (1 << BITS))
    return np.log((1 - FLOOR) * model + FLOOR / (1 << BITS)).T.astype(np.float32)


def rare_counts(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, cell, n, total): trigram counts of the languages that share the slot, as a table."""

    def run(batches):
        for batch in batches:
            declared, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(declared)):
                for group in _groups([t for t, d in zip(texts, declared) if d == lang]):
                    bucket, start, n = trigrams(group)
                    at, times = np.unique(np.concatenate([bucket[s : s + k] for s, k in zip(start, n)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(times.astype(np.int64))], names=["lang", "cell", "n"])

    rare = rows.where(F.col("declared").isNotNull() & ~F.col("declared").isin(langs)).select("declared", "text")
    counts = staged(rare.mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    return counts.join(counts.groupBy("lang").agg(F.sum("n").alias("total")), "lang")


def fill_rare(weighed: DataFrame, counts: DataFrame, langs: list[str]) -> DataFrame:
    """``weighed`` with the best rare language and its weight in the slot; rows that asked for none cannot be in it."""
    cells = weighed.where(F.col("cells").isNotNull()).select("_row", "declared", "n_grams", F.explode(F.arrays_zip("cells", "times")).alias("c"))
    cells = cells.select("_row", "declared", "n_grams", F.col("c.cells").alias("cell"), F.col("c.times").alias("times")).join(counts, "cell")
    mine = F.coalesce(F.col("declared") == F.col("lang"), F.lit(False)).cast("bigint")
    floor = FLOOR / (1 << BITS)
    p = (1 - FLOOR) * F.greatest(F.col("n") - mine * F.col("times"), F.lit(0)) / F.greatest(F.col("total") - mine * F.col("n_grams"), F.lit(1)) + floor
    gain = cells.groupBy("_row", "n_grams", "lang").agg(F.sum(F.col("times") * F.log(p / floor)).alias("g"))
    ll = (F.col("g") / F.col("n_grams") + float(np.log(floor))) * F.least(F.col("n_grams"), F.lit(ENOUGH))
    best = gain.groupBy("_row").agg(F.max(F.struct(F.round(ll, 6).alias("ll"), "lang")).alias("best"))
    n = len(langs) - 1
    out = weighed.join(best, "_row", "left").withColumn("rare_lang", F.col("best.lang"))
    out = out.withColumn("ll", F.concat(F.slice("ll", 1, n), F.array(F.coalesce("best.ll", F.lit(-1e9))), F.slice("ll", n + 2, 1)))
    names = F.array(*map(F.lit, langs))
    return _decided(out, langs).drop("_row", "cells", "times", "n_grams", "best")


def _decided(rows: DataFrame, langs: list[str]) -> DataFrame:
    """Adds ``text_lang``, the language that explains the text best, and ``text_class``, noise among the choices."""
    names = F.array(*map(F.lit, [*langs, NOISE]))
    pick = lambda v: F.when(F.col("n_bytes") > 0, F.element_at(names, F.array_position(v, F.array_max(v)).cast("int")))
    return rows.withColumn("text_lang", pick(F.slice("ll", 1, len(langs)))).withColumn("text_class", pick(F.col("ll")))


def identify(docs: DataFrame, text: Column | None = None, declared: Column | None = None, host: Column | None = None, id_col: str = "doc_id", key: str | None = None, min_share: float = 0.005, host_weight: float = 4.0) -> DataFrame:
    """(id, lang_pred, posterior, text_lang, n_bytes, rejected) of every row, and ``k``: the column named by ``key``."""
    text = F.col("text") if text is None else text
    blank = F.lit(None).cast("string")
    host = blank if host is None else host
    declared = blank if declared is None else F.when(F.trim(declared) != "", F.lower(F.trim(declared)))
    more = [] if key is None else ["k"]
    rows = docs.select(F.col(id_col).alias("id"), declared.alias("declared"), host.alias("host"), text.alias("text"), *[F.col(key).alias("k") for _ in more])
    langs = languages(rows, min_share)
    if not langs:
        letters = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-@\[-`{-~]+", ""))
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
        return rows.select(F.col("id").alias(id_col), blank.alias("lang_pred"), F.lit(None).cast("double").alias("posterior"), blank.alias("text_lang"), size.alias("n_bytes"), (letters == 0).alias("rejected"), *more)
    model = docs.sparkSession.sparkContext.broadcast(train(rows, langs))
    n_lang, named = len(langs), set(langs)
    noise, kept = np.float32(-BITS * np.log(2)), [c for c in rows.columns if c != "text"]

    def weigh(batches):
        table = np.concatenate((model.value, np.full((1 << BITS, 1), noise, dtype=np.float32)), axis=1)
        table = np.concatenate((table, np.zeros((1, n_lang + 1), dtype=np.float32)))
        for batch in batches:
            parts, sizes, letters, held, grams = [], [], [], [], []
            for group in _groups(batch.column(3).to_pylist()):
                bucket, start, n = trigrams(group)
                parts.append(summed(table, bucket, start, n) / n[:, None] * np.minimum(n, ENOUGH)[:, None])
                sizes += [len(t) for t in group]
                if langs[-1] == RARE:
                    declared = batch.column(1).slice(len(held), len(group)).to_pylist()
                    asks = (parts[-1].argmax(axis=1) >= n_lang - 1) | np.array([d is not None and d not in named for d in declared])
                    held += [np.unique(bucket[s : s + k], return_counts=True) if ask else (None, None) for s, k, ask in zip(start, n, asks)]
                    grams += n.tolist()
                letters += [sum(map(len, t.translate(None, NOT_LETTERS).split())) for t in group]
            ll = np.concatenate(parts) if parts else np.zeros((0, n_lang + 1))
            sizes = np.array(sizes, dtype=np.int64)
            more = [pa.array([x[0] for x in held], pa.list_(pa.int32())), pa.array([x[1] for x in held], pa.list_(pa.int64())), pa.array(grams, pa.int64())] if langs[-1] == RARE else []
            yield pa.RecordBatch.from_arrays(
                [*batch.select(kept).columns, pa.array(list(ll), pa.list_(pa.float64())), pa.array(sizes), pa.array(np.array(letters, dtype=np.int64)), *more],
                names=[*kept, "ll", "n_bytes", "letters", *("cells", "times", "n_grams")[: len(more)]],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    weighed = rows.mapInArrow(weigh, f"{kinds}, ll array<double>, n_bytes bigint, letters bigint" + ", cells array<int>, times array<bigint>, n_grams bigint" * (langs[-1] == RARE))
    if langs[-1] == RARE:
        first = staged(weighed.withColumn("_row", F.monotonically_increasing_id()))
        weighed = staged(fill_rare(first, rare_counts(rows, langs), langs))
        discard(first)
    else:
        weighed = staged(_decided(weighed.withColumn("rare_lang", blank), langs))
    return fuse(weighed, langs, id_col, more, host_weight)


def accepted(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they were.

    Texts are read twice and never written or shuffled: what is staged is the class weights of each row and the
    keys of the rejected ones, which come back as an anti-join (broadcast only below a checked size)."""
    rows, key = keyed(docs)
    found = identify(rows, F.col(text_col), F.col(declared_col), F.col(host_col), id_col, key)
    return keep_rows(rows, key, staged(found.where("rejected").select("k"))).select(*own_columns(docs))


def _given_from(met: DataFrame, rows: DataFrame, column: str, names: list[str], per: list[Column]) -> DataFrame:
    """``met`` with an array ``g_<column>`` of log P(value | class) from grouped counts of text-only decisions.

    One row a value is joined: Spark broadcasts the table if it is small, else adaptive execution splits hot
    values. A null value is no evidence and meets nothing."""
    counts = staged(rows.where(F.col(column).isNotNull()).groupBy(column).agg(*per).withColumnRenamed(column, "_v"))
    whole = counts.agg(F.count("*").alias("n"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]).first()
    logs = F.array(*[F.log((F.col(f"n{i}") + 1.0) / ((whole[f"n{i}"] or 0.0) + whole["n"] + 1.0)) for i in range(len(names))])
    spread = F.coalesce(F.col(column), F.concat(F.lit("\0"), F.xxhash64("id", "ll").cast("string")))
    out = met.withColumn("_k", spread).join(counts.select("_v", logs.alias(f"g_{column}")), F.col("_k") == F.col("_v"), "left")
    return out.withColumn(f"g_{column}", F.coalesce(f"g_{column}", F.array(*[F.lit(0.0)] * len(names)))).drop("_k", "_v")


def fuse(rows: DataFrame, langs: list[str], id_col: str, more: list[str], host_weight: float) -> DataFrame:
    suffix = suffix_of(F.col("host"))
    domain = F.coalesce(F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), F.col("host"))
    rows = rows.withColumn("suffix", suffix).withColumn("domain", domain)
    names = [*langs, NOISE]
    size = len(names)
    per = [F.sum(F.when(F.col("text_class") == x, 1.0).otherwise(0.0)).alias(f"n{i}") for i, x in enumerate(names)]
    vector = lambda prefix: F.array(*[F.col(f"{prefix}{i}") for i in range(size)])
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda v, prior: F.zip_with(v, prior, lambda n, p: (n + host_weight * p) / (total(v) + host_weight))
    whole = rows.agg(*per).first()
    everywhere = np.array([whole[f"n{i}"] or 0.0 for i in range(size)]) + 1
    top = F.array(*[F.lit(float(x)) for x in everywhere / everywhere.sum()])
    hosts = rows.where(F.col("host").isNotNull()).groupBy("domain", "host").agg(*per).select("domain", "host", vector("n").alias("h"))
    domains = hosts.groupBy("domain").agg(*[F.sum(F.element_at("h", i + 1)).alias(f"n{i}") for i in range(size)]).select(F.col("domain").alias("_d"), vector("n").alias("d"))
    priors = staged(hosts.join(domains, F.col("domain") == F.col("_d")).select(F.col("host").alias("_h"), "h", "d"))
    # a host that holds much of the rows: small sides are broadcast by Spark, else the skewed join is split
    spread = F.coalesce(F.col("host"), F.concat(F.lit("\0"), F.xxhash64("id", "ll").cast("string")))
    met = rows.withColumn("_k", spread).join(priors, F.col("_k") == F.col("_h"), "left").drop("_k", "_h")
    for column in ("declared", "suffix"):
        met = _given_from(met, rows, column, names, per)
    own = F.array(*[F.when(F.col("text_class") == x, 1.0).otherwise(0.0) for x in names])
    others = lambda v: F.zip_with(v, own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
    prior = F.coalesce(smooth(others(F.col("h")), smooth(others(F.col("d")), top)), top)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    text = F.when(F.col("n_bytes") > 0, F.col("ll")).otherwise(F.array(*[F.lit(0.0)] * size))
    logs = add(add(F.transform(prior, lambda x: F.log(x)), text), add(F.col("g_declared"), F.col("g_suffix")))
    code = F.coalesce(F.col("declared").rlike("^[a-z]{2,3}([-_]|$)"), F.lit(False))
    met = met.withColumn("logs", logs).withColumn("logs", F.concat(F.slice("logs", 1, size - 1), F.array(F.when(code, -1e9).otherwise(F.element_at("logs", size)))))
    met = met.withColumn("spoken", F.slice("logs", 1, size - 1)).withColumn("most", F.array_max("spoken")).withColumn("peak", F.array_max("logs"))
    met = met.withColumn("posterior", F.exp(F.col("most") - F.col("peak")) / F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("peak"))), F.lit(0.0), lambda a, x: a + x))
    plain = lambda c: F.when(c == RARE, F.col("rare_lang")).otherwise(c)
    best = plain(F.element_at(F.array(*map(F.lit, langs)), F.array_position("spoken", F.col("most")).cast("int")))
    rejected = (F.col("n_bytes") == 0) | (F.col("letters") == 0) | (F.element_at("logs", size) > F.col("most"))
    return met.select(F.col("id").alias(id_col), best.alias("lang_pred"), "posterior", plain(F.col("text_lang")).alias("text_lang"), "n_bytes", rejected.alias("rejected"), *more)
