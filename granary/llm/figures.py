"""Accuracy of the trained operators on documents that they weren't fitted on: python -m granary.llm.figures SF_DIR."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import html, html_pages, langid, quality_model
from granary.llm.queries import table


def quality(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """op4: of labelled documents outside the sample, the share judged rightly, good ones rejected and bad ones kept."""
    unseen = quality_model.sampled(labels).where("not chosen").select("doc_id", "label")
    found = quality_model.classify(docs, labels).join(unseen, "doc_id").groupBy("label", "kept").count().collect()
    by = {(r["label"], r["kept"]): r["count"] for r in found}
    total = sum(by.values())
    return {"unseen": total, "right": (by.get((1, True), 0) + by.get((0, False), 0)) / max(1, total), "good_rejected": by.get((1, False), 0), "bad_kept": by.get((0, True), 0)}


def languages(docs: DataFrame) -> dict[str, float]:
    """op7: of held-out documents with a language and letters, the share named rightly."""
    said = langid.identify(docs).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    row = said.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    return {"held_out": row.n, "right": row.right}


def blocks(pages: int = 200) -> dict[str, float]:
    """op8: of the blocks of drawn pages that it wasn't trained on, the share labelled rightly."""
    chain, right, total = html.default_chain(), 0, 0
    for found, labels in html_pages.labelled(pages, seed=77):
        right += sum(a == b for a, b in zip(chain.decode(html.vector(found)), labels))
        total += len(labels)
    return {"blocks": total, "right": right / total}


def main(sf_dir: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = table(spark, sf_dir, "documents")
    print(json.dumps({"op4": quality(docs, table(spark, sf_dir, "labels")), "op7": languages(docs), "op8": blocks()}))


if __name__ == "__main__":
    main(sys.argv[1])
