"""Quality by hierarchical empirical Bayes.

A document's own evidence is a logistic classifier of text statistics, fitted to labels. Sites (hosts) and paths below them
have quality rates of their own: labels where there are any, else the classifier's probabilities, summed by grouped
aggregation. Rates of sites follow a beta distribution whose mean and strength are estimated from all sites by moments, and a
path's rate shrinks toward its site's in the same way, so sparse sites and paths stay near what lies above them. A document's
posterior combines its evidence with its path's rate as prior odds. What a document says of itself is taken out of every
rate that it meets: its path's, its site's and the mean of all; only strengths are those of all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import by_bytes, materialize, text_buffer, word_hashes

#: Labelled rows of each label that the classifier is fitted on at most: those of least hash.
TRAIN_EACH = 6000
#: Longer texts aren't trained on, and all that are take no more than this.
TRAIN_TEXT_BYTES = 1 << 20
TRAIN_BYTES = 64 << 20
#: Least and most strength of a prior, in documents.
STRENGTH = (1.0, 1000.0)
KEEP = 0.5
#: A path with more than one in so many documents is joined in as many parts; there are fewer such paths than this.
PARTS = 256


def statistics(column) -> np.ndarray:
    """A row of numbers for each text: how long, how varied, and of what characters."""
    raw, at = text_buffer(column)
    n = np.diff(at).astype(float)
    words, begin = word_hashes(raw, at)
    classes = np.zeros((256, 7))
    classes[[*range(65, 91)], 0] = classes[[*range(48, 58)], 1] = classes[10, 2] = classes[124, 3] = 1
    classes[[33, 63], 4] = classes[[35, 36, 37, 38, 42, 64, 94, 126], 5] = classes[[44, 46, 59, 58], 6] = 1
    share = np.zeros((len(n), 7))
    some = np.flatnonzero(n)
    for k in range(7):
        if len(some):
            share[some, k] = np.add.reduceat(classes[raw, k], at[some]) / n[some]
    count = np.diff(begin)
    again = np.zeros(len(n))
    distinct = np.ones(len(n))
    for d in np.flatnonzero(count > 1):
        w = words[begin[d] : begin[d + 1]]
        again[d] = np.mean(w[1:] == w[:-1])
        distinct[d] = len(np.unique(w)) / len(w)
    mean = n / np.maximum(count, 1)
    return np.column_stack([np.log1p(count), np.minimum(mean, 50) / 10, np.sqrt(share), np.sqrt(again), distinct])


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.column_stack([np.ones(len(z)), z, np.minimum(z * z, 9), z > 1.5, z < -1.5])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights; a ridge keeps weights finite where labels separate or are missing."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    a = _design(x, mean, scale)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)), a.T @ (y - p) - w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, seed: int = 0) -> tuple[np.ndarray, ...]:
    """The classifier, from rows of docs with a label in labels (doc_id, quality) whose doc_id isn't held out (a Column's test).

    Of each label at most TRAIN_EACH doc_ids of least hash, and of their texts, in the order of a second hash, those that take at
    most TRAIN_BYTES in all. Null texts are empty; texts of more than TRAIN_TEXT_BYTES aren't trained on, so one can't keep the
    others out. Of several rows of a doc_id that of the smallest text counts; where its labels differ it is good. Null ids and
    labels other than 0 and 1 take no part. Empty tables, or no labels of rows of docs: a classifier that says one half of every
    text; where there are some but all of texts too long, an error. Other columns don't matter."""
    own = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    take = lambda y: own.filter(F.col("quality") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(TRAIN_EACH)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= TRAIN_TEXT_BYTES)
    rows = texts.join(take(0).unionByName(take(1)), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    order = W.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)  # a bounded sample
    rows = rows.withColumn("so_far", F.sum(F.octet_length("text")).over(order)).filter(F.col("so_far") <= TRAIN_BYTES)

    def run(batches):
        t = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("quality", pa.int32())])).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        found = fit_logistic(statistics(t.column("text")), t.column("quality").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64())) for x in found], ["mean", "scale", "w"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality").repartition(1).mapInArrow(run, "mean array<double>, scale array<double>, w array<double>").first()
    if found:
        return tuple(map(np.array, found))
    if not own.join(docs.select("doc_id"), "doc_id", "left_semi").isEmpty():
        raise ValueError(f"all labelled texts have more than {TRAIN_TEXT_BYTES} bytes")
    return fit_logistic(statistics(pa.array([], pa.string())), np.zeros(0))


def evidence(docs: DataFrame, model: tuple[np.ndarray, ...]) -> DataFrame:
    """docs with evidence, the classifier's probability, instead of text."""
    mean, scale, w = model
    at = docs.columns.index("text")
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in by_bytes(batches, at):
            p = 1 / (1 + np.exp(-np.clip(_design(statistics(b.column(at)), mean, scale) @ w, -12, 12)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(p, pa.float64())], [*rest, "evidence"])

    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("evidence", T.DoubleType())]))


def _strength(between: Column, mean: Column) -> Column:
    """Documents' worth of a prior from the variance of rates that sampling doesn't explain."""
    return F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1))


def posteriors(scored: DataFrame) -> DataFrame:
    """scored (site, path, known: a label or null, evidence, ...) with site_rate, path_rate, score and keep.

    A document's value is its label where known, else its evidence. Its site_rate is (sum of the site's other documents'
    values + s * m) / (their number + s), m the mean of all other documents' values (one half where there are none) and s the
    sites' strength; its path_rate is the same of the path's other documents and its site_rate, with the path's strength. Null
    sites and paths are a site and a path of their own. A group of any size is summed by partial aggregation; what is joined
    back has a row for each path, or some for a path that many documents share, each for a part of them."""
    value = F.coalesce(F.col("known").cast("double"), F.col("evidence"))
    paths = materialize(scored.groupBy("site", "path").agg(F.sum(value).alias("good"), F.count(F.lit(1)).alias("n")), "quality-paths")
    sites = paths.groupBy("site").agg(F.sum("good").alias("site_good"), F.sum("n").alias("site_n"))
    total = sites.agg(F.sum("site_good").alias("all_good"), F.sum("site_n").alias("all_n"), (F.sum("site_good") / F.sum("site_n")).alias("mean"))
    # Moments: the variance of site rates beyond that of samples of their sizes.
    rate = F.col("site_good") / F.col("site_n")
    between = F.sum(F.col("site_n") * ((rate - F.col("mean")) ** 2 - F.col("mean") * (1 - F.col("mean")) / F.col("site_n"))) / F.sum("site_n")
    spread = sites.crossJoin(F.broadcast(total)).agg(F.first("mean").alias("mean"), F.first("all_good").alias("all_good"), F.first("all_n").alias("all_n"), between.alias("between"))
    prior = spread.select("mean", "all_good", "all_n", _strength(F.col("between"), F.col("mean")).alias("strength"))
    whole = (F.col("site_good") + F.col("strength") * F.col("mean")) / (F.col("site_n") + F.col("strength"))
    sites = sites.crossJoin(F.broadcast(prior)).withColumn("whole", whole).withColumnRenamed("site", "its_site").drop("mean")
    paths = materialize(paths.join(sites, F.col("site").eqNullSafe(F.col("its_site"))).drop("its_site"), "quality-sites")
    below = F.col("good") / F.col("n")
    within = paths.agg((F.sum(F.col("n") * ((below - F.col("whole")) ** 2 - F.col("whole") * (1 - F.col("whole")) / F.col("n"))) / F.sum("n")).alias("between"))
    rates = paths.crossJoin(F.broadcast(within)).withColumn("path_strength", _strength(F.col("between"), F.col("whole")))
    used = ["good", "n", "site_good", "site_n", "all_good", "all_n", "strength", "path_strength"]
    of_path = lambda prefix: F.col("site").eqNullSafe(F.col(f"{prefix}_site")) & F.col("path").eqNullSafe(F.col(f"{prefix}_path"))
    parts = F.ceil(F.col("n") * PARTS / F.col("all_n")).cast("int")
    hot = rates.filter(F.col("n") * PARTS > F.col("all_n")).select(F.col("site").alias("hot_site"), F.col("path").alias("hot_path"), parts.alias("of_parts"))
    part = F.explode(F.sequence(F.lit(0), parts - 1)).alias("its_part")
    rates = rates.select(F.col("site").alias("its_site"), F.col("path").alias("its_path"), part, *[F.col(c).alias(f"of_{c}") for c in used])
    out = scored.join(F.broadcast(hot), of_path("hot"), "left").drop("hot_site", "hot_path")  # fewer than PARTS rows
    out = out.withColumn("of_part", F.coalesce(F.pmod(F.xxhash64("doc_id", "evidence"), F.col("of_parts")).cast("int"), F.lit(0)))
    out = out.join(rates, of_path("its") & (F.col("of_part") == F.col("its_part"))).drop("its_site", "its_path", "its_part")
    others = lambda good, n, strength, prior: (F.col(f"of_{good}") - value + strength * prior) / (F.col(f"of_{n}") - 1 + strength)
    mean = F.when(F.col("of_all_n") > 1, (F.col("of_all_good") - value) / (F.greatest(F.col("of_all_n"), F.lit(2)) - 1)).otherwise(0.5)
    bounded = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    logit = lambda p: F.log(bounded(p) / (1 - bounded(p)))
    out = out.withColumn("site_rate", others("site_good", "site_n", F.col("of_strength"), mean))
    out = out.withColumn("path_rate", others("good", "n", F.col("of_path_strength"), F.col("site_rate")))
    odds = logit(F.col("evidence")) - logit(mean) + logit(F.col("path_rate"))
    out = out.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.withColumn("keep", F.col("score") >= KEEP).drop(*[f"of_{c}" for c in used], "of_parts", "of_part")


def url_levels(url: Column) -> tuple[Column, Column]:
    """Site (host without www. and port, lower case) and path (first segment) of a URL, for tables that have one."""
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)(?::[0-9]*)?/?([^/?#]*)", 1)
    return rest, F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*/?([^/?#]*)", 1)


def assess(docs: DataFrame, labels: DataFrame, site: Column, path: Column, held_out: Column, seed: int = 0) -> DataFrame:
    """doc_id, site, path, evidence, site_rate, path_rate, score (posterior that quality is 1) and keep for each row of docs.

    Labels of held-out doc_ids are used nowhere. Null and empty texts have the evidence of their statistics, very long ones
    too, whole; null doc_ids have no label; repeated rows are rows each; scores of exactly KEEP are kept. No labels: evidence
    says nothing, and rates stay near one half. No rows: no rows. Other columns don't matter, whatever their names.
    """
    rows = docs.select("doc_id", site.alias("site"), path.alias("path"), F.col("text").cast("string").alias("text"))
    scored = materialize(evidence(rows, fit(docs, labels, held_out, seed)), "quality-evidence")
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out).groupBy("doc_id").agg(F.max("quality").alias("known"))
    # Rows without an id have no label: they aren't looked up, so they don't meet in one task.
    labelled = scored.filter("doc_id IS NOT NULL").join(known, "doc_id", "left")
    nameless = scored.filter("doc_id IS NULL").withColumn("known", F.lit(None).cast(known.schema["known"].dataType))
    return posteriors(labelled.unionByName(nameless)).drop("known")


def page_text(html: Column) -> Column:
    """The text of a page: no scripts, styles and comments, a line for each block, a few entities decoded."""
    text = F.regexp_replace(html.cast("string"), r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|nav|header|footer|section|article|body)\b[^>]*>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", ""), r"[ \t\r]*\n\s*", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def assess_pages(pages: DataFrame, docs: DataFrame, labels: DataFrame, held_out: Column, seed: int = 0) -> DataFrame:
    """page_id, site, path, evidence, site_rate, path_rate, score and keep for each row of pages (page_id, url, html).

    Pages have no labels: the classifier is that of docs and their labels, and a page's host and the first segment of its path
    lend what their other pages show. Null addresses are a site of their own, as are those that name no host; null, empty and
    very long pages have the evidence of their text's statistics; repeated rows are rows each. No rows: no rows. Other columns
    don't matter, whatever their names."""
    site, path = url_levels(F.col("url"))
    rows = pages.select(F.col("page_id").alias("doc_id"), site.alias("site"), path.alias("path"), page_text(F.col("html")).alias("text"))
    scored = materialize(evidence(rows, fit(docs, labels, held_out, seed)), "quality-pages")
    found = posteriors(scored.withColumn("known", F.lit(None).cast("int")))
    return found.select(F.col("doc_id").alias("page_id"), "site", "path", "evidence", "site_rate", "path_rate", "score", "keep")
