"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import budget, consensus, encoding, markup, overlap, packing, pairs, residue, splitting
from siltstone.plans.registry import Registry
from siltstone.sources.tables import table

registry = Registry()

#: White space as Python's str.isspace has it, for RE2.
_SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@registry.add("p1_found")
def p1_found(spark, sf_dir):
    judged, _ = consensus.consensus(table(spark, sf_dir, "qrels"), table(spark, sf_dir, "spot_audit"), least=3)
    return judged.select("query_id", "chunk_id", "relevance")


@registry.add("p1_consensus")
def p1_consensus(spark, sf_dir):
    return consensus.consensus(table(spark, sf_dir, "qrels"), table(spark, sf_dir, "spot_audit"))[0]


@registry.add("p1_annotators")
def p1_annotators(spark, sf_dir):
    labels, names = consensus.pair_labels(consensus.usable_grades(table(spark, sf_dir, "qrels"), table(spark, sf_dir, "spot_audit")))
    return consensus.annotator_report(consensus.fit_communities(labels, names), spark)


@registry.add(
    "p2_found",
    rf"""WITH current AS (
  SELECT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, length(text) > 3500 DESC, text DESC NULLS LAST) = 1)
SELECT chunk_id, CASE WHEN list_max(list_transform(regexp_extract_all(text, '[^{_SPACE}。！？]+'), lambda x: length(x))) > 3500
  THEN 'forced' ELSE 'natural' END AS cut
FROM current WHERE length(text) > 3500""",
)
def p2_found(spark, sf_dir):
    return splitting.split_kinds(table(spark, sf_dir, "chunks"))


@registry.add("p2_pieces")
def p2_pieces(spark, sf_dir):
    return splitting.split_chunks(table(spark, sf_dir, "chunks"))


@registry.add("p3_found")
def p3_found(spark, sf_dir):
    return pairs.broken_pairs(table(spark, sf_dir, "turns"))


@registry.add("p4_found")
def p4_found(spark, sf_dir):
    return markup.markup_families(table(spark, sf_dir, "chunks"))


@registry.add("p4_clean")
def p4_clean(spark, sf_dir):
    return markup.clean_chunks(table(spark, sf_dir, "chunks"))


@registry.add("p5_found")
def p5_found(spark, sf_dir):
    found = overlap.split_overlaps(table(spark, sf_dir, "natural_queries"))
    return found.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b")).distinct()


@registry.add("p5_counts")
def p5_counts(spark, sf_dir):
    questions = table(spark, sf_dir, "natural_queries")
    return overlap.overlap_counts(overlap.split_overlaps(questions), questions)


@registry.add(
    "p7_found",
    r"""WITH current AS (
  SELECT chunk_id, token_estimate, loaded_at, CAST(trunc(
      1.2::DOUBLE * (length(text) - length(regexp_replace(text, '[\x{4E00}-\x{9FFF}]', '', 'g')))
    + 1.3::DOUBLE * len(regexp_extract_all(text, '[A-Za-z0-9_]+'))
    + length(regexp_replace(text, '[A-Za-z0-9_\x{4E00}-\x{9FFF}]', '', 'g')) / 4.0::DOUBLE) AS INTEGER) AS tokens
  FROM chunks WHERE chunk_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, tokens DESC, token_estimate DESC NULLS LAST) = 1)
SELECT chunk_id FROM current WHERE token_estimate IS NULL OR abs(token_estimate - tokens) > 0.1 * tokens""",
)
def p7_found(spark, sf_dir):
    return budget.wrong_estimates(table(spark, sf_dir, "chunks")).select("chunk_id")


@registry.add("p7_budget")
def p7_budget(spark, sf_dir):
    return budget.budget_rollup(table(spark, sf_dir, "documents"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "source_manifest"))


@registry.add("p8_ids")
def p8_ids(spark, sf_dir):
    return encoding.encode_texts(table(spark, sf_dir, "documents"))


@registry.add("p9_containers")
def p9_containers(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@registry.add("p9_summary")
def p9_summary(spark, sf_dir):
    return packing.packing_summary(packing.pack_documents(table(spark, sf_dir, "documents")))


@registry.add("p10_found")
def p10_found(spark, sf_dir):
    return residue.template_residue(table(spark, sf_dir, "documents")).select("doc_id")


@registry.add("p10_kinds")
def p10_kinds(spark, sf_dir):
    return residue.template_residue(table(spark, sf_dir, "documents"))


@registry.add("p10_usable")
def p10_usable(spark, sf_dir):
    usable = residue.usable_documents(table(spark, sf_dir, "documents"))
    return usable.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.char_length("text")).alias("characters"))
