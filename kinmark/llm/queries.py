"""The pN_ queries and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .survivor import survivors

    return survivors(table(spark, sf_dir, "matcher")).select("group", "row_id")


def p1_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .survivor import judged_representatives

    return judged_representatives(table(spark, sf_dir, "matcher"))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .survivor import judged_values

    return judged_values(table(spark, sf_dir, "matcher"))


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .survivor import source_quality

    return source_quality(table(spark, sf_dir, "matcher"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lookalike import ordinary_forms

    return ordinary_forms(table(spark, sf_dir, "matcher"))


def p2_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lookalike import lookalike_groups

    return lookalike_groups(table(spark, sf_dir, "matcher"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linked import linked_strings

    return linked_strings(table(spark, sf_dir, "pair_links"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .splits import related_pairs

    return related_pairs(table(spark, sf_dir, "matcher"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .splits import grouped_splits

    return grouped_splits(table(spark, sf_dir, "matcher"), table(spark, sf_dir, "split_shares")).select("row_id", "split")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .splits import split_report

    return split_report(p4_splits(spark, sf_dir), table(spark, sf_dir, "matcher"), table(spark, sf_dir, "split_shares"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import link_variants

    return link_variants(table(spark, sf_dir, "matcher"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .copies import copies_found

    return copies_found(table(spark, sf_dir, "matcher"))


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .copies import collapsed

    return collapsed(table(spark, sf_dir, "matcher")).select("keep_id", "norm", "copies", "total")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .copies import collapsed_records

    return collapsed_records(table(spark, sf_dir, "matcher"), ["string", "group", "feed"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import neighbour_pairs

    return neighbour_pairs(table(spark, sf_dir, "stored_vectors"))


def p8_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .boxes import filled_boxes

    return filled_boxes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "box_sizes"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .boxes import box_report, filled_boxes

    sizes = table(spark, sf_dir, "box_sizes")
    return box_report(filled_boxes(table(spark, sf_dir, "documents"), sizes), sizes)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixture import mixed_documents

    return mixed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixture import mix_report, mixed_documents

    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(mixed_documents(table(spark, sf_dir, "documents"), targets), targets)


def p9_exact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixture import mix_report, mixed_documents

    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(mixed_documents(table(spark, sf_dir, "documents"), targets, exact_shares=True), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentences import sentences

    return sentences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    p1_found, p1_judged, p1_values, p1_sources, p2_found, p2_skeletons, p3_found, p4_found, p4_splits, p4_report, p5_found, p6_found, p6_collapsed, p6_records, p7_found,
    p8_boxes, p8_report, p9_mix, p9_report, p9_exact_report, p10_found,
)}

SQL: dict[str, str] = {
    # totals are the shares of all rows, to within a row, and no group is parted
    "p4_report": """
        SELECT split, share, CAST(round(share / (SELECT sum(share) FROM split_shares) * (SELECT count(*) FROM matcher)) AS BIGINT) AS rows,
          round(share / (SELECT sum(share) FROM split_shares), 4) AS reached, CAST(0 AS BIGINT) AS parted FROM split_shares""",
    "p1_found": """
        WITH once AS (SELECT "group", string, "count" AS n, feed, seen_at, min(row_id) AS row_id FROM matcher
                      WHERE "group" IS NOT NULL AND string IS NOT NULL GROUP BY ALL),
             best AS (SELECT "group", string, sum(coalesce(n, 1)) AS weight, count(*) OVER (PARTITION BY "group") AS strings FROM once GROUP BY "group", string),
             chosen AS (SELECT "group", string, row_number() OVER (PARTITION BY "group" ORDER BY weight DESC, string) AS k FROM best WHERE strings > 1)
        SELECT "group", row_id FROM (SELECT o."group", o.row_id,
                 row_number() OVER (PARTITION BY o."group" ORDER BY o.n IS NULL, o.seen_at DESC, o.row_id) AS k
               FROM once o JOIN chosen c ON c."group" = o."group" AND c.string = o.string AND c.k = 1) WHERE k = 1""",
    "p3_found": """
        WITH RECURSIVE pairs AS (SELECT DISTINCT a, b FROM (
                 SELECT string0 AS a, string1 AS b FROM pair_links UNION ALL SELECT string0, group0 FROM pair_links UNION ALL SELECT string1, group1 FROM pair_links)
               WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
             edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
             reach(string, other) USING KEY (string) AS (
               SELECT a, min(least(a, b)) FROM edges GROUP BY a
               UNION SELECT e.a, min(r.other) FROM edges e JOIN recurring.reach r ON r.string = e.b JOIN recurring.reach own ON own.string = e.a
               WHERE r.other < own.other GROUP BY e.a)
        SELECT string, other AS rep FROM reach""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
