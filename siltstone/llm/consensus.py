"""Consensus from several annotators: a community confusion model fitted by variational updates.

Annotators belong, by degrees, to a few types with shared confusion matrices. Each has a confusion matrix of its
own whose prior is centred on its types', so that one with few labels stays close to them and one with many
follows their own labels. Items are distributed: an update is one pass that sums, per annotator, the expected
counts of (true grade, given grade). Only those sums - 16 numbers per annotator - reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut
from siltstone.sources.tables import latest

GRADES = 4
TYPES = 5
#: Labels' worth of belief in the types' matrices, and in the starting shape of a type.
STRENGTH, SHAPE = 12.0, 4.0
UPDATES, STILL = 40, 1e-4


def _instant(column: str):
    """An ISO 8601 text with an offset as an instant; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""), "[zZ]$", "+00:00"))


def usable_grades(qrels: DataFrame, audits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, annotator, grade): the latest usable grade of each annotator for each pair.

    Usable is an integer from 0 to 3. Annotators are the same when their names differ only in case and outer
    blanks; grades without a name, query or chunk are left out, a null time is the earliest, grades of the same
    instant go to the higher one. llm, codex and human of the audits are three more annotators, whose names can't
    clash with others'. Repeated rows collapse.
    """
    name = F.lower(F.regexp_replace("annotator", r"^\s+|\s+$", ""))
    given = qrels.select("query_id", "chunk_id", name.alias("annotator"), F.col("relevance").cast("int").alias("grade"), _instant("updated_at").alias("at"))
    given = given.filter(F.col("grade").between(0, GRADES - 1) & (F.col("annotator") != ""))
    given = latest(given, ["query_id", "chunk_id", "annotator"], ["at"], ["grade"])
    three = F.explode(F.array(*[F.struct(F.lit(f"spot_audit.{who}").alias("annotator"), F.col(f"{who}_relevance").cast("int").alias("grade")) for who in ("llm", "codex", "human")]))
    audited = audits.select("query_id", "chunk_id", three.alias("g")).select("query_id", "chunk_id", "g.annotator", "g.grade").filter(F.col("grade").between(0, GRADES - 1))
    audited = latest(audited, ["query_id", "chunk_id", "annotator"], [], ["grade"])
    return given.unionByName(audited)


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    low = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        low = np.where(small, low - 1 / x, low)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return low + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


_lgamma = np.vectorize(lgamma, otypes=[float])


@dataclass
class Model:
    """annotators' log confusion (J, true, given), log prior of the grades, and what is reported about annotators."""

    names: list[str]
    log_confusion: np.ndarray
    log_prior: np.ndarray
    confusion: np.ndarray
    types: np.ndarray
    labels: np.ndarray


def _starting_types() -> np.ndarray:
    """Careful, fair, guessing, one step high, reversed: shapes that the updates move to fit the data."""
    near = np.abs(np.subtract.outer(np.arange(GRADES), np.arange(GRADES)))
    careful, fair = np.exp(-2.0 * near), np.exp(-0.8 * near)
    up = np.exp(-1.5 * np.abs(np.minimum(np.arange(GRADES) + 1, GRADES - 1)[:, None] - np.arange(GRADES)[None, :]))
    shapes = np.stack([careful, fair, np.ones((GRADES, GRADES)), up, careful[:, ::-1]])[:TYPES]
    return shapes / shapes.sum(2, keepdims=True)


def update_annotators(counts: np.ndarray, centres: np.ndarray, start: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(degrees of membership, types' matrices, weights, Dirichlet parameters) from expected counts (J, true, given)."""
    belief = STRENGTH * centres  # (M, c, g)
    fit = np.empty((len(counts), len(centres)))
    for m in range(len(centres)):
        a = belief[m]
        fit[:, m] = np.log(weights[m]) + (_lgamma(a.sum(1))[None] - _lgamma(a.sum(1)[None] + counts.sum(2))).sum(1) + (_lgamma(a[None] + counts) - _lgamma(a)[None]).sum((1, 2))
    fit -= fit.max(1, keepdims=True)
    degrees = np.exp(fit)
    degrees /= degrees.sum(1, keepdims=True)
    # An annotator's own rows count for their type in proportion, each annotator alike, however many labels.
    rows = counts / np.maximum(counts.sum(2, keepdims=True), 1e-9)
    seen = counts.sum(2, keepdims=True) / (counts.sum(2, keepdims=True) + STRENGTH)
    moved = SHAPE * start / 4 + np.einsum("jm,jcg->mcg", degrees, rows * seen)
    centres = moved / moved.sum(2, keepdims=True)
    weights = (degrees.sum(0) + 1) / (len(counts) + len(centres))
    return degrees, centres, weights, counts + STRENGTH * np.einsum("jm,mcg->jcg", degrees, centres) + 0.05


def _posteriors(who: np.ndarray, grade: np.ndarray, ends: np.ndarray, log_confusion: np.ndarray, log_prior: np.ndarray) -> np.ndarray:
    scores = log_confusion[who, :, grade]  # (labels, true)
    total = np.concatenate([np.zeros((1, GRADES)), np.cumsum(scores, 0)])
    items = total[ends[1:]] - total[ends[:-1]] + log_prior
    items -= items.max(1, keepdims=True)
    q = np.exp(items)
    return q / q.sum(1, keepdims=True)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = [pa.array(batch.column(i)) for i in (0, 1)]
    who, grade = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
    sizes = np.array([len(x) for x in lists[0]], np.int64) if lists[0].null_count else np.diff(lists[0].offsets.to_numpy())
    return who, grade, np.concatenate([[0], np.cumsum(sizes)])


def pair_labels(grades: DataFrame) -> tuple[DataFrame, list[str]]:
    """((query_id, chunk_id, who, grade), names): a row per pair with its annotators' numbers and grades, written out."""
    names = sorted(r[0] for r in grades.select("annotator").distinct().collect())  # as many as there are annotators
    spark = grades.sparkSession
    known = spark.createDataFrame(list(zip(names, range(len(names)))), "annotator string, j int") if names else spark.createDataFrame([], "annotator string, j int")
    rows = grades.join(known, "annotator").groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("j", "grade"))).alias("l"))
    return cut(rows.select("query_id", "chunk_id", F.col("l.j").alias("who"), F.col("l.grade").alias("grade"))), names


def fit_communities(pairs: DataFrame, names: list[str], updates: int = UPDATES) -> Model:
    """Variational updates over all pairs until the expected counts stand still."""
    many = len(names)
    start = _starting_types()
    centres, weights = start, np.full(len(start), 1 / len(start))

    def gather(log_confusion: np.ndarray | None, log_prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, prior = np.zeros((many, GRADES, GRADES)), np.zeros(GRADES)
            for batch in batches:
                who, grade, ends = _flat(batch)
                if log_confusion is None:  # the first pass believes the labels, each as much as any other
                    votes = np.zeros((len(ends) - 1, GRADES))
                    item = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                    np.add.at(votes, (item, grade), 1)
                    q = (votes + 0.25) ** 2
                    q /= q.sum(1, keepdims=True)
                else:
                    q = _posteriors(who, grade, ends, log_confusion, log_prior)
                    item = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                np.add.at(counts.transpose(0, 2, 1), (who, grade), q[item])
                prior += q.sum(0)
            sums = np.append(counts.ravel(), prior)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["i", "v"])

        # Partitions are added up in the executors: what reaches the driver is 16 numbers per annotator, and 4.
        sums = np.zeros(many * GRADES * GRADES + GRADES)
        for r in pairs.select("who", "grade").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            sums[r.i] = r.v
        return sums[:-GRADES].reshape(many, GRADES, GRADES), sums[-GRADES:]

    counts, prior = gather(None, np.zeros(GRADES))
    degrees = np.full((many, len(start)), 1 / len(start))
    dirichlet = counts + 1
    log_prior = np.zeros(GRADES)
    for _ in range(updates if many else 0):
        for _ in range(3):
            degrees, centres, weights, dirichlet = update_annotators(counts, centres, start, weights)
        log_confusion = _digamma(dirichlet) - _digamma(dirichlet.sum(2, keepdims=True))
        log_prior = _digamma(prior + 1) - _digamma((prior + 1).sum())
        before = counts
        counts, prior = gather(log_confusion, log_prior)
        if np.abs(counts - before).sum() <= STILL * max(1.0, counts.sum()):
            break
    degrees, centres, weights, dirichlet = update_annotators(counts, centres, start, weights) if many else (degrees, centres, weights, dirichlet)
    confusion = dirichlet / dirichlet.sum(2, keepdims=True)
    return Model(names, _digamma(dirichlet) - _digamma(dirichlet.sum(2, keepdims=True)), log_prior, confusion, degrees, counts.sum((1, 2)))


def consensus(qrels: DataFrame, audits: DataFrame, least: int = 1) -> tuple[DataFrame, Model]:
    """(query_id, chunk_id, relevance, confidence, agreement, n_grades) per pair with at least `least` usable grades.

    relevance is the most probable true grade under the model fitted to all pairs, confidence its probability,
    agreement the share of the pair's annotator couples that gave the same grade (null for a single grade). Equal
    probabilities go to the lower grade. No grades at all give an empty table.
    """
    pairs, names = pair_labels(usable_grades(qrels, audits))
    model = fit_communities(pairs, names)
    log_confusion, log_prior = model.log_confusion, model.log_prior

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, grade, ends = _flat(batch.select([2, 3]))
            q = _posteriors(who, grade, ends, log_confusion, log_prior)
            best = q.argmax(1)
            sizes = np.diff(ends)
            votes = np.zeros((len(sizes), GRADES))
            np.add.at(votes, (np.repeat(np.arange(len(sizes)), sizes), grade), 1)
            couples = sizes * (sizes - 1)
            same = np.divide((votes * (votes - 1)).sum(1), couples, out=np.full(len(sizes), np.nan), where=couples > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(best.astype(np.int32)),
                    pa.array(q[np.arange(len(best)), best]),
                    pa.array(same, mask=couples == 0),
                    pa.array(sizes.astype(np.int32)),
                ],
                names=["query_id", "chunk_id", "relevance", "confidence", "agreement", "n_grades"],
            )

    judged = pairs.filter(F.size("who") >= least).mapInArrow(judge, "query_id string, chunk_id string, relevance int, confidence double, agreement double, n_grades int")
    return judged, model


def annotator_report(model: Model, spark) -> DataFrame:
    """(annotator, n_grades, reliability, community, membership) per annotator.

    reliability is the probability that the annotator gives an item's true grade, over the grades' prior; community
    is the type the annotator belongs to most, membership the degree.
    """
    prior = np.exp(model.log_prior)
    prior = prior / prior.sum()
    rows = [
        (name, float(round(model.labels[j])), float((prior * np.diag(model.confusion[j])).sum()), int(model.types[j].argmax()), float(model.types[j].max()))
        for j, name in enumerate(model.names)
    ]
    return spark.createDataFrame(rows, "annotator string, n double, reliability double, community int, membership double").select(
        "annotator", F.col("n").cast("long").alias("n_grades"), "reliability", "community", "membership"
    )
