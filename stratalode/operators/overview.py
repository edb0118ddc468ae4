"""Facts of whole repositories put together: an orchestrated row per repository, cards and their merge, trees, imports, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import code, facts, ingest, repair


def display_name(repo: Column) -> Column:
    """The last part of a repository's name, its words capitalised."""
    return F.initcap(F.trim(F.regexp_replace(F.element_at(F.split(repo, "/"), -1), r"[-_.]+", " ")))


def repository_facts(files: DataFrame, framework: Column) -> DataFrame:
    """One row per repository: counts, main language, documents, tests, entry points, frameworks, name and description.

    One aggregation over narrow columns; ``framework`` gives an array of framework names per file. The description is the first
    sentence of the readme nearest to the root.
    """
    path = F.col("repo_relative_path")
    name = ingest.basename(path)
    lang = facts.language_of(path, F.lower(F.trim("kind")))
    slim = files.select(
        "repo", F.lower(F.trim("kind")).alias("k"), F.coalesce("bytes", F.lit(0)).alias("bytes"), lang.alias("language"), framework.alias("frameworks"),
        path.rlike(r"(?i)(^|/)(test|tests|__tests__|spec)/|\.(test|spec)\.").alias("is_test"), name.rlike(code.ENTRY).alias("is_entry"),
        F.when(F.lower(name).startswith("readme"), F.struct(F.size(F.split(path, "/")).alias("depth"), path.alias("path"), repair.summary_of(ingest.normal_text(F.col("text"))).alias("s"))).alias("readme"))
    counted = slim.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("k") == "code").alias("code_files"), F.count_if(F.col("k") == "doc").alias("documents"), F.count_if("is_test").alias("tests"),
        F.count_if("is_entry").alias("entry_points"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("frameworks")))), ",").alias("frameworks"), F.min("readme").alias("readme"))
    most = slim.where("language is not null and k = 'code'").groupBy("repo", "language").agg(F.count("*").alias("n"))
    main = most.groupBy("repo").agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col("language").alias("l"))).alias("m")).select("repo", F.col("m.l").alias("main_language"))
    return counted.join(main, "repo", "left").select("repo", display_name(F.col("repo")).alias("name"), F.col("readme.s").alias("description"), "main_language", *[c for c in counted.columns if c not in ("repo", "readme")])


def merge_cards(old: DataFrame, new: DataFrame, key: str = "repo") -> DataFrame:
    """Two versions of cards by key: new values win where they are not null, arrays are united, cards of one side stay."""
    a, b = old.alias("a"), new.alias("b")
    kinds = dict(old.dtypes)
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    one = lambda c: (
        F.array_sort(F.array_distinct(F.concat(F.coalesce(f"a.{c}", F.array().cast(kinds[c])), F.coalesce(f"b.{c}", F.array().cast(kinds[c])))))
        if kinds[c].startswith("array") else F.coalesce(f"b.{c}", f"a.{c}"))
    return both.select(*[one(c).alias(c) for c in old.columns])


def rendered_tree(files: DataFrame, depth: int = 2) -> DataFrame:
    """(repo, place, line): the folders down to ``depth`` and the files at the top of each repository as an indented list, in the order of their paths."""
    parts = F.split("repo_relative_path", "/")
    folders = files.select("repo", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(parts)))).alias("n"), parts.alias("p")).where(F.col("n") <= F.size("p"))
    rows = folders.select("repo", "n", F.array_join(F.slice("p", 1, F.col("n")), "/").alias("path"), (F.size("p") > F.col("n")).alias("folder"))
    nodes = rows.groupBy("repo", "n", "path").agg(F.bool_or("folder").alias("folder"), F.count("*").alias("files"))
    line = F.concat(F.repeat(F.lit("  "), F.col("n") - 1), F.element_at(F.split("path", "/"), -1), F.when(F.col("folder"), F.concat(F.lit("/ ("), F.col("files").cast("string"), F.lit(")"))).otherwise(""))
    return nodes.select("repo", F.col("path").alias("place"), line.alias("line"))


def entry_candidates(files: DataFrame, most: int = 5) -> DataFrame:
    """(repo, path, rank): files a reader starts with: readme, then files whose name or text starts a program, nearest to the root first."""
    name = ingest.basename(F.col("repo_relative_path"))
    kind = F.when(F.lower(name).startswith("readme"), 0).when(name.rlike(code.ENTRY), 1).when(F.col("text").rlike(r"(?m)^\s*(if __name__ ==|func main\(|fn main\(|public static void main)"), 2)
    rows = files.select("repo", F.col("repo_relative_path").alias("path"), kind.alias("kind"), F.size(F.split("repo_relative_path", "/")).alias("depth")).where("kind is not null")
    w = Window.partitionBy("repo").orderBy("kind", "depth", "path")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("repo", "path", "rank")


IMPORT = r"(?m)^[ \t]*(?:import[ \t]+(?:[^'\"\n]*[ \t]from[ \t]+)?['\"]([^'\"\n]+)['\"]|from[ \t]+([\w.]+)[ \t]+import|import[ \t]+([\w.]+)|#include[ \t]+[<\"]([^>\"\n]+)[>\"]|use[ \t]+([\w:]+))"


def import_rows(files: DataFrame) -> DataFrame:
    """(path, nth, target) of all imports of the usual languages, in their order; a narrow map."""
    t = ingest.normal_text(F.col("text"))
    groups = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(IMPORT), F.lit(i)).alias(f"g{i}") for i in range(1, 6)])
    rows = files.where("text is not null").select("path", F.posexplode(groups).alias("nth", "g"))
    return rows.select("path", "nth", F.concat(*[F.coalesce(f"g.g{i}", F.lit("")) for i in range(1, 6)]).alias("target")).where("target <> ''")


def related(entities: DataFrame, relations: DataFrame, name: str, hops: int = 1) -> DataFrame:
    """(entity, distance): entities linked with one, in either direction, within a few hops; relations give (src, dst)."""
    both = relations.select("src", "dst").unionByName(relations.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = entities.where(F.col("entity") == name).select("entity", F.lit(0).alias("distance"))
    last = seen
    for k in range(1, hops + 1):
        near = last.join(both.withColumnRenamed("src", "entity"), "entity").select(F.col("dst").alias("entity")).distinct().join(seen, "entity", "left_anti")
        last = near.withColumn("distance", F.lit(k))
        seen = seen.unionByName(last)
    return seen.join(entities, "entity", "left_semi")


def issue_summary(issues: DataFrame) -> DataFrame:
    """(severity, issues, files): issues (path, severity, ...) with the number of different files that have them."""
    return issues.groupBy("severity").agg(F.count("*").alias("issues"), F.count_distinct("path").alias("files"))
