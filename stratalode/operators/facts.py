"""Facts about repositories: languages, structure, kinds, complexity, levels, quality, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import basename, extension, normal_text

# Extension -> language (fixed values).
CODE_LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".py": "Python", ".go": "Go", ".rs": "Rust", ".java": "Java", ".rb": "Ruby", ".php": "PHP", ".c": "C", ".cpp": "C++", ".cc": "C++",
    ".h": "C/C++", ".hpp": "C++", ".cs": "C#", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".sh": "Shell", ".bash": "Shell",
    ".zsh": "Shell",
}
DOC_LANGUAGES = {".md": "Markdown", ".mdx": "Markdown", ".rst": "reStructuredText", ".adoc": "AsciiDoc", ".txt": "Plain Text"}
CODE_SHARE, DOC_SHARE = 0.3, 0.1


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language_of(path: Column, kind: Column) -> Column:
    e = extension(path)
    return F.when(kind == "code", F.coalesce(lookup(e, CODE_LANGUAGES), F.lit("Other"))).when(kind == "doc", lookup(e, DOC_LANGUAGES))


def languages(files: DataFrame) -> DataFrame:
    """(language, file_count, extensions)."""
    kind = F.lower(F.trim("kind"))
    return (
        files.select(language_of(F.col("repo_relative_path"), kind).alias("language"), extension(F.col("repo_relative_path")).alias("ext"))
        .where("language is not null").groupBy("language")
        .agg(F.count("*").alias("file_count"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("extensions"))
    )


def structure(files: DataFrame) -> DataFrame:
    """Per repository: totals, documents, code, number of top folders, tests, configuration."""
    p = F.lower("repo_relative_path")
    test = p.rlike(r"(^|/)(test|tests|__tests__|spec)/|\.(test|spec)\.")
    config = p.rlike(r"(^|/)(package\.json|tsconfig\.json|pyproject\.toml|setup\.py|cargo\.toml|go\.mod|pom\.xml|makefile|dockerfile)$|config")
    top = F.when(p.contains("/"), F.substring_index(F.col("repo_relative_path"), "/", 1))
    kind = F.lower(F.trim("kind"))
    return files.groupBy("repo").agg(
        F.count("*").alias("total_files"), F.sum((kind == "doc").cast("long")).alias("doc_files"), F.sum((kind == "code").cast("long")).alias("code_files"),
        F.count_distinct(top).alias("top_dirs"), F.bool_or(test).alias("has_tests"), F.bool_or(config).alias("has_config"))


def classify_repos(files: DataFrame) -> DataFrame:
    """(repo, code_ratio, repo_type): by the share of code files; data collections without an entry point are documentation."""
    name = F.lower(basename(F.col("repo_relative_path")))
    ext = extension(F.col("repo_relative_path"))
    data = ext.isin(".json", ".csv", ".tsv", ".parquet", ".yaml", ".yml", ".xml")
    md = ext.isin(".md", ".mdx", ".rst", ".adoc", ".txt")
    code = ext.isin(*CODE_LANGUAGES)
    entry = name.rlike(r"^(index|main|app|server|cli|lib)\.")
    skills = name == "skill.md"
    agg = files.groupBy("repo").agg(
        F.count("*").alias("n"), F.sum(code.cast("long")).alias("code"), F.sum(data.cast("long")).alias("data"), F.sum(md.cast("long")).alias("md"),
        F.bool_or(entry).alias("entry"), F.bool_or(skills).alias("skills"))
    ratio = F.col("code") / F.col("n")
    awesome = F.lower("repo").contains("awesome")
    is_data = ~F.col("entry") & (F.col("data") + F.col("md") > F.col("code")) & (F.col("data") > 0)
    return agg.select("repo", F.round(ratio, 6).alias("code_ratio"), F.when(F.col("skills") | awesome | is_data, "documentation")
                      .when(ratio >= CODE_SHARE, "code").when(ratio < DOC_SHARE, "documentation").otherwise("hybrid").alias("repo_type"))


def tree(files: DataFrame) -> DataFrame:
    """(repo, folder, depth, files, bytes) for every folder on the way to a file; one row per level leaves each file."""
    parts = F.split("repo_relative_path", "/")
    level = F.explode(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))).alias("depth")
    return (
        files.select("repo", "bytes", parts.alias("parts"), level)
        .groupBy("repo", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("folder"), "depth")
        .agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    )


def lines_of_code(text: Column) -> Column:
    """Lines that are neither blank nor line comments."""
    return F.size(F.filter(F.split(normal_text(text), "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("//")))


def complexity_bucket(loc: Column, imports: Column) -> Column:
    score = loc / 100 + imports / 5
    return F.when(score < 2, "low").when(score < 5, "medium").otherwise("high")


def module_role(path: Column, importers: Column) -> Column:
    p = F.lower(path)
    has = lambda *xs: __import__("functools").reduce(lambda a, b: a | b, [p.contains(x) for x in xs])
    return (
        F.when(has("/test/", "/tests/", "/__tests__/", ".test.", ".spec."), "test").when(has("config", "/scripts/"), "config")
        .when(has("/example", "/demo"), "example").when(importers >= 2, "core")
        .when(has("/util", "/helper") | (importers > 0), "utility").otherwise("unknown")
    )


def collection_level(m: Column) -> Column:
    """The level of the hierarchy that a chunk belongs to, from its metadata."""
    section = F.lower(F.trim(F.regexp_replace(m["section_heading"], r"^\d+\.?\s*", "")))
    st, gran, lvl = m["source_type"], m["granularity"], m["heading_level"]
    return (
        F.when(st == "overview", "l1_doc").when(st == "repocard", "l1_repo")
        .when((st == "pdf_text") & (gran == "section") & (lvl == 1) & section.isin("abstract", "introduction", "summary", "overview"), "l1_pdf")
        .when((gran == "section") | ((st == "pdf_text") & (lvl > 0) & (lvl <= 2)), "l2_section").when(st == "code", "l2_section").otherwise("l3_chunk")
    )


def parse_quality(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Per text: pages, hyphenation and garbling ratios, tables, figures, formulas, number of issues."""
    n = F.length("t")
    pages = F.regexp_count("t", F.lit(r"(?i)page\s+\d+"))
    words = F.size(F.split("t", r"\s+"))
    hyphen = F.regexp_count("t", F.lit(r"\w+-\n\w+")) / words
    garbled = F.when(n > 0, (n - F.length(F.regexp_replace("t", r"[\x00-\x08\x0B\x0C\x0E-\x1F�]", ""))) / n).otherwise(0.0)
    base = df.select(F.col(id_col).alias("id"), text.alias("t")).where("t is not null")
    return base.select(
        "id", F.when(pages > 0, pages).otherwise(F.ceil(n / 3000)).cast("long").alias("page_count"), hyphen.alias("hyphenation_ratio"),
        garbled.alias("garbled_ratio"), F.floor(F.regexp_count("t", F.lit(r"\|.*\|.*\|")) / 2).alias("tables"),
        F.regexp_count("t", F.lit(r"!\[[^\]]*\]\([^)]*\)")).alias("figures"), F.regexp_count("t", F.lit(r"\$\$[^$]*\$\$")).alias("formulas"),
        ((hyphen > 0.05).cast("int") + (garbled > 0.01).cast("int")).alias("issues"))


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """Per bundle: chunks, orphans (fine chunks without a parent), parents that do not exist, blank and polluted contents.

    The existence test is a semi join of the distinct parent ids against the ids, not a lookup per row.
    """
    m = F.col("metadata")
    base = chunks.select("id", m["bundle_id"].alias("bundle_id"), m["parent_chunk_id"].alias("parent"), m["granularity"].alias("granularity"), "content").dropDuplicates(["id"])
    ids = base.select(F.col("id").alias("parent"), F.lit(True).alias("exists"))
    joined = base.join(ids, "parent", "left")
    return joined.groupBy("bundle_id").agg(
        F.count("*").alias("chunks"),
        F.count_if((F.col("granularity") == "element") & F.col("parent").isNull()).alias("orphans"),
        F.count_if(F.col("parent").isNotNull() & F.col("exists").isNull()).alias("invalid_parents"),
        F.count_if(F.coalesce(F.trim("content"), F.lit("")) == "").alias("blank"),
        F.count_if(F.col("content").contains("�")).alias("polluted"))


def pdf_score(parse_issues: Column, orphans: Column, invalid: Column, chunk_issues: Column) -> Column:
    """0-100: 30 for parsing, 40 for chunks, 30 for retrieval (full where it was not tested)."""
    parse = F.greatest(F.lit(0), 30 - parse_issues * 10)
    chunk = F.when(chunk_issues == 0, 40).otherwise(
        F.greatest(F.lit(0), 40 - F.least(F.lit(20), orphans * 5) - F.when(invalid > 0, 10).otherwise(0) - chunk_issues * 5))
    return parse + chunk + 30


# Tag -> pattern over lower-case paths (fixed values).
TAG_PATTERNS = {
    "api": r"(^|/)(api|routes|endpoints)/", "cli": r"(^|/)(cli|cmd|bin)/", "database": r"(^|/)(db|database|migrations|models)/",
    "testing": r"(^|/)(test|tests|__tests__|spec)/", "web": r"\.(css|html|tsx|jsx)$", "docs": r"(^|/)(doc|docs|wiki|guide)/",
    "infra": r"(^|/)(docker|k8s|deploy|terraform|\.github)/", "search": r"(search|index|retriev|rank)", "parsing": r"(parse|token|lexer)",
}


def tags(files: DataFrame) -> DataFrame:
    """(repo, tag, files): one vote per file and matching tag."""
    p = F.lower("repo_relative_path")
    votes = F.filter(F.array(*[F.when(p.rlike(rx), F.lit(t)) for t, rx in TAG_PATTERNS.items()]), lambda x: x.isNotNull())
    return files.select("repo", F.explode(votes).alias("tag")).groupBy("repo", "tag").agg(F.count("*").alias("files"))


# Architecture -> (layer -> pattern), minimum of layers, base, step, cap (fixed values).
ARCHITECTURES = {
    "mvc": ({"models": r"/models?/", "views": r"/views?/", "controllers": r"/controllers?/"}, 2, 0.5, 0.1, 0.95),
    "repository": ({"repository": r"/repositor(y|ies)/|repository\."}, 1, 0.5, 0.05, 0.75),
    "service": ({"service": r"/services?/|service\."}, 1, 0.5, 0.04, 0.8),
    "layered": ({"presentation": r"/(presentation|ui|web|app)/", "domain": r"/(domain|core|business)/", "data": r"/(data|persistence|infrastructure|internal)/"}, 2, 0.55, 0.1, 0.9),
    "clean": ({"entities": r"/(entities|domain)/", "usecases": r"/(usecases?|application)/", "adapters": r"/(adapters?|interfaces?)/", "frameworks": r"/(frameworks?|infrastructure)/"}, 3, 0.6, 0.08, 0.9),
}


def architectures(files: DataFrame) -> DataFrame:
    """(repo, pattern, layers, confidence) from paths alone: one evidence row per file and layer, then counts."""
    p = F.lower(F.concat(F.lit("/"), "repo_relative_path"))
    votes = [F.when(p.rlike(rx), F.struct(F.lit(a).alias("pattern"), F.lit(layer).alias("layer"))) for a, (ls, *_) in ARCHITECTURES.items() for layer, rx in ls.items()]
    rows = files.select("repo", F.explode(F.filter(F.array(*votes), lambda x: x.isNotNull())).alias("v")).select("repo", "v.*")
    agg = rows.groupBy("repo", "pattern").agg(F.count_distinct("layer").alias("layers"), F.count("*").alias("n"))
    keep, conf = F.lit(False), F.lit(None).cast("double")
    for a, (ls, need, base, step, cap) in ARCHITECTURES.items():
        k = F.col("layers") if len(ls) > 1 else F.col("n")
        enough = (F.col("layers") >= need) if len(ls) > 1 else (F.col("n") >= 2)
        keep = keep | ((F.col("pattern") == a) & enough)
        conf = F.when(F.col("pattern") == a, F.least(F.lit(cap), base + step * k)).otherwise(conf)
    return agg.where(keep).select("repo", "pattern", "layers", F.round(conf, 6).alias("confidence"))
