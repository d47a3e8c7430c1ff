"""Quality by hierarchical empirical Bayes: a document's own evidence with that of its site.

Evidence of a document is a naive Bayes log likelihood ratio over binned text
statistics, counted over all labelled documents and then calibrated. Sites have
levels, such as host and path. The expected number of good documents of a site
is a sum over its documents; a Beta prior shrinks it to the level above, hosts
to the whole, paths to their host. How strongly is estimated from the spread of
the sites themselves by the method of moments. What a document adds to its own
site is taken out again before the site speaks for it.

All of it is grouped sums; a site's rows are summed before they are shuffled,
so that a host with a third of all documents is a few rows. The driver sees
histograms of a fixed size and a few sums.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small
from .toxicity import fit, held_out

BINS = 12
#: Log likelihood ratios are binned in steps of 1 / STEPS between -LIMIT and LIMIT for calibration.
STEPS, LIMIT = 2, 20
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6


def site_of(url: str | Column) -> tuple[Column, Column]:
    """(host, path): the host without www. or m. in lower case, and the first step of the path; empty if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), "^(www|m)\\.", "")
    return host, F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/([^/]*)", 1)


def features(text: str = "text") -> dict[str, Column]:
    """Text statistics as evidence; zeros for a null or blank text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.expr(f"array_remove(split(coalesce(`{text}`, ''), '[ \\\\t-\\\\r]+'), '')")
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(t), F.lit(1))

    def rate(marks: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, marks, ""))) / chars

    return {
        "symbols": rate("#*$%&|<>"),
        "bangs": rate("!"),
        "capitals": rate("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "distinct": F.size(F.array_distinct(words)) / n,
        "word_length": F.length(t) / n,
        "n_words": F.size(words).cast("double"),
    }


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def evidence(rows: DataFrame, names: list[str]) -> tuple[Column, float]:
    """(calibrated log likelihood ratio of good to bad, share of good) from rows with a label ``y`` (null: none) and the features."""
    known = rows.where("y is not null")
    at = [i / BINS for i in range(1, BINS)]
    cuts = known.agg(*(F.percentile_approx(f, F.array(*map(F.lit, at)), F.lit(10_000)).alias(f) for f in names)).first()
    cuts = {f: sorted(set(cuts[f] or [])) for f in names}

    def bin_of(f: str) -> Column:
        return sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0))

    cells = known.select("y", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), bin_of(f).alias("b")) for i, f in enumerate(names)))).alias("x"))
    counts = {(r.f, r.b, r.y): r["count"] for r in cells.groupBy("x.f", "x.b", "y").count().collect()}
    n = [sum(v for (f, _, y), v in counts.items() if f == 0 and y == k) for k in (0, 1)]
    if not all(n):
        return F.lit(0.0), (n[1] + 1) / (sum(n) + 2)
    ratio = F.lit(0.0)
    for i, f in enumerate(names):
        k = len(cuts[f]) + 1
        llr = [math.log((counts.get((i, b, 1), 0) + 0.5) / (n[1] + 0.5 * k)) - math.log((counts.get((i, b, 0), 0) + 0.5) / (n[0] + 0.5 * k)) for b in range(k)]
        ratio = ratio + F.element_at(F.array(*map(F.lit, llr)), bin_of(f) + 1)
    ratio = F.greatest(F.least(ratio, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    hist = known.groupBy(F.round(ratio * STEPS).cast("int").alias("r"), "y").count().collect()  # at most 2 * (2 * LIMIT * STEPS + 1) rows
    w = fit(np.array([[r.r / STEPS] for r in hist]), np.array([float(r.y) for r in hist]), times=np.array([float(r["count"]) for r in hist]))
    share = n[1] / sum(n)
    return F.lit(float(w[0]) - math.log(share / (1 - share))) + F.lit(float(w[1])) * ratio, share


def _strength(sites: DataFrame, mean: Column) -> float:
    """Of the Beta prior around ``mean``: by the spread of the sites' shares (good / n), less what chance gives."""
    share, m = F.col("good") / F.col("n"), mean
    row = sites.where("n >= 2").agg(F.sum("n"), F.sum(F.col("n") * (share - m) ** 2), F.sum(F.col("n") * m * (1 - m)), F.sum(m * (1 - m)), F.count("*")).first()
    n, spread, within, chance, k = (float(x or 0) for x in row)
    if k < 2 or within <= 0:
        return STRONGEST
    # E[sum n (share - m)^2] = sum m (1 - m) (1 + (n - 1) / (strength + 1))
    rho = (spread - chance) / max(within - chance, 1e-12)
    return STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, 1 / rho - 1))


def site_quality(docs: DataFrame, labels: DataFrame, host: str | Column, path: str | Column) -> DataFrame:
    """doc_id, evidence, host_quality, path_quality, quality, kept of every row.

    Labels of held-out documents are never learned from. A null host or path is
    a site of its own. Without both labels the evidence is zero.
    """
    host, path = (F.col(x) if isinstance(x, str) else x for x in (host, path))
    of = features()
    y = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = docs.select("doc_id", host.alias("host"), path.alias("path"), *(c.alias(f) for f, c in of.items()))
    rows = rows.join(y.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    rows = materialize(rows, "features")
    llr, share = evidence(rows, list(of))
    rows = rows.select("doc_id", "host", "path", "y", llr.alias("evidence"))
    rows = rows.withColumn("p", F.coalesce(F.col("y").cast("double"), _sigmoid(_logit(F.lit(share)) + F.col("evidence"))))
    rows = materialize(rows, "evidence")
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    mean = good / n if n else 0.5
    a = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("_h"), ((F.lit(a * mean) + F.col("good")) / (a + F.col("n"))).alias("host_quality"), F.col("n").alias("_hn"), F.col("good").alias("_hgood"))
    paths = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).drop("_h"), "sites")
    b = _strength(paths, F.col("host_quality"))
    paths = paths.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_quality", "_hn", "_hgood", F.col("n").alias("_n"), F.col("good").alias("_good"))
    rows = rows.join(small(paths), F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    above = (F.lit(a * mean) + F.col("_hgood") - F.col("p")) / (a + F.col("_hn") - 1)
    others = (b * above + F.col("_good") - F.col("p")) / (b + F.col("_n") - 1)
    quality = _sigmoid(_logit(others) + F.col("evidence"))
    return rows.select("doc_id", "evidence", "host_quality", others.alias("path_quality"), quality.alias("quality"), (quality >= 0.5).alias("kept"))
