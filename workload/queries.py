"""One query per operator, over whole tables. Results are made of scalars so that engines can be compared."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions import cleaning, glob, markup, secrets, text, tokens, urls
from sheaf.functions.secrets import SecretRule
from sheaf.operators import clean, history, metrics, render, select, split, status, tree
from sheaf.operators import secrets as secret_ops
from sheaf.plans import pack
from sheaf.session import shared_folder
from sheaf.sources import commit_log, file_source, files, sinks, tables
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GLOBS = ["*.go", "/src1/*", "src?/**/d1*", "**/src5/**", "d[1-3]?.*", "src1/en/*", "d*[!0-4].s[a-z]l", "fr"]
INCLUDES = ["*.go", "src1/**/*.sql", "d[0-4]*.py", "en/"]
IGNORES = ["*.log", "!d6*.log", "src3/", "**/source/**", "src1/**/d?.*", "!*.py", "/src2/en/*", "d[7-9]*", "!src0/**"]
DIR_IGNORES = ["src3/", "en", "!src2/en", "/src5", "!src4/en/", "src6/*/src1*", "*.go"]
EXTRA_RULES = [SecretRule("Long Number", "[0-9]{7,}"), SecretRule("Mail", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+\.[a-z]+", 3.2)]
SPLIT_BYTES = 6000
GENERATED = "2024-05-03T00:00:00Z"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def md5_of(column: str, name: str = "digest"):
    return F.md5(F.col(column).cast("binary")).alias(name)


def long(c, name: str):
    return c.cast("long").alias(name)


# --- sources ----------------------------------------------------------------------------


@query
def scan_corpus_table(spark, sf_dir):
    got = tables.scan_corpus_table(spark, f"{sf_dir}/documents.parquet", F.expr(views.REL_PATH), "text")
    return got.select("rel_path", "bytes", "is_binary", md5_of("content"))


@query
def scan_corpus_files(spark, sf_dir):
    """Documents written as a tree of text files, one folder per language and source, and read back."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    docs = views.table(spark, sf_dir, "documents").select("lang", "source", "text")
    docs.write.partitionBy("lang", "source").option("maxRecordsPerFile", 2000).text(root)
    scanned = files.scan_corpus_files(spark, root, include=["part-*"], max_file_bytes=0)
    per_file = scanned.select(
        text.parent_dir("rel_path").alias("dir"), "bytes", text.count_lines("content").alias("lines"), "skip_reason"
    )
    return per_file.groupBy("dir").agg(
        F.sum("bytes").alias("bytes"), long(F.sum("lines"), "lines"), F.count("skip_reason").alias("skipped")
    )


@query
def file_source_read(spark, sf_dir):
    """The same tree through the data source, with a path filter that it takes; contents by a digest of their lines."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    docs = views.table(spark, sf_dir, "documents").select("lang", "source", "text")
    docs.write.partitionBy("lang", "source").option("maxRecordsPerFile", 2000).text(root)
    file_source.register(spark)
    found = spark.read.format(file_source.NAME).load(root).where(F.col("rel_path").contains("/part-") & F.col("rel_path").startswith("lang="))
    lines = found.select(text.parent_dir("rel_path").alias("dir"), F.explode(F.split(F.col("raw").cast("string"), "\n", -1)).alias("line"))
    digest = F.conv(F.substring(F.md5(F.col("line").cast("binary")), 1, 8), 16, 10).cast("long")
    return lines.where("line <> ''").groupBy("dir").agg(long(F.count("*"), "lines"), long(F.sum(digest), "digest"))


@query
def select_manifest(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels")
    docs = views.table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "source", f"{views.REL_PATH} as rel_path")
    labelled = docs.join(labels, "doc_id")
    manifest = labelled.where("quality = 1").select(F.concat(F.lit("  "), "rel_path", F.lit(" ")).alias("line"))
    manifest = manifest.unionByName(labelled.select(F.concat(F.lit("# "), "rel_path").alias("line")))
    folder = F.regexp_extract("rel_path", "^(.*)/", 1).alias("line")
    manifest = manifest.unionByName(labelled.where("toxic = 1 and quality = 0").select(folder))
    return select.select_manifest(docs.select("rel_path"), manifest)


@query
def union_roots(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").selectExpr("concat('/r/', cast(doc_id as string)) as abs_path", "text as content")
    pages = views.table(spark, sf_dir, "pages").selectExpr("concat('/r/', cast(page_id * 3 as string)) as abs_path", "html as content")
    return select.union_roots([pages, docs]).select("abs_path", md5_of("content"))


@query
def scan_ignore_rules(spark, sf_dir):
    rules = views.documents(
        spark,
        sf_dir,
        content=RULE_TEXT,
        path="concat(lang, '/', source, '/', cast(doc_id as varchar(20)), '/.gitignore')",
    )
    return select.scan_ignore_rules(rules).select(
        "scope_dir", "file_ord", "line_no", "pattern", "negate", "dir_only", "anchored"
    )


RULE_TEXT = "replace(replace(replace(text, '. ', concat(chr(10), '!')), ', ', concat('/', chr(10), '/')), ' un ', concat(chr(10), '#'))"


@query
def scan_commit_log(spark, sf_dir):
    """Orders written as a commit log with their parts as touched files, and read back."""
    location = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    touched = views.commit_files(spark, sf_dir)
    orders = views.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "hash").join(touched, "hash", "left_semi")
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat_ws(commit_log.FIELD, F.col("hash").cast("string"), F.col("o_custkey").cast("string"), date, "o_orderpriority")
    heads = orders.select("hash", F.lit(0).alias("step"), F.concat(F.lit(commit_log.MARKER), head).alias("value"))
    names = touched.select("hash", F.lit(1).alias("step"), F.concat(F.lit(" "), "path", F.lit("\n")).alias("value"))
    lines = heads.unionByName(names).repartitionByRange("hash").sortWithinPartitions("hash", "step", "value")
    lines.select("value").write.text(location)
    parsed = commit_log.scan_commit_log(spark, location)
    return parsed.select("hash", "author", "date", "message", F.explode_outer("files").alias("path"))


# --- filters and classification ---------------------------------------------------------


@query
def glob_match(spark, sf_dir):
    paths = views.documents(spark, sf_dir).select("rel_path")
    return paths.select("rel_path", *[glob.glob_match("rel_path", p).alias(f"g{i}") for i, p in enumerate(GLOBS)])


@query
def include_filter(spark, sf_dir):
    return select.include_filter(views.corpus(spark, sf_dir), INCLUDES).select("rel_path", "bytes")


@query
def ignore_filter(spark, sf_dir):
    return select.ignore_filter(views.corpus(spark, sf_dir), IGNORES).select("rel_path", "bytes")


@query
def ignored_dir_prune(spark, sf_dir):
    return select.ignored_dir_prune(views.corpus(spark, sf_dir), DIR_IGNORES).select("rel_path", "bytes")


@query
def default_ignores(spark, sf_dir):
    corpus = views.corpus(spark, sf_dir, path=views.TOOL_PATH)
    patterns = select.default_ignores()
    kept = select.ignored_dir_prune(select.ignore_filter(corpus, patterns), patterns)
    return kept.select("rel_path", "bytes")


@query
def nested_ignores(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    docs.createOrReplaceTempView("documents")
    rule_files = spark.sql(views.RULE_FILES).selectExpr("concat(dir, '/.gitignore') as rel_path", "content")
    top = docs.select(F.lit(".ignore").alias("rel_path"), F.lit("/src4/\n*.png\n").alias("content")).distinct()
    rules = select.scan_ignore_rules(rule_files.unionByName(top))
    return select.nested_ignores(views.corpus(spark, sf_dir), rules, ["*.go", "d1*.lua"]).select("rel_path", "bytes")


@query
def max_size_filter(spark, sf_dir):
    return select.max_size_filter(views.corpus(spark, sf_dir), 4000).select("rel_path", "bytes")


@query
def binary_by_ext(spark, sf_dir):
    return status.binary_by_ext(views.documents(spark, sf_dir)).select("rel_path", "is_binary")


def raw_documents(spark, sf_dir) -> DataFrame:
    """Texts as bytes: as they are, with a NUL behind, or behind runs of invalid bytes."""
    docs = views.table(spark, sf_dir, "documents")
    raw = F.col("text").cast("binary")
    size = F.octet_length("text")
    filler = F.unhex(F.repeat(F.lit("FF"), F.when(F.col("doc_id") % 4 == 2, F.floor(size / 5) + 1000).otherwise(F.floor(size / 50))))
    body = (
        F.when(F.col("doc_id") % 4 == 0, raw)
        .when(F.col("doc_id") % 4 == 1, F.concat(raw, F.unhex(F.lit("00"))))
        .otherwise(F.concat(filler, raw))
    )
    error = F.when(F.col("doc_id") % 10 == 3, F.lit("permission denied"))
    return docs.select(F.expr(views.REL_PATH).alias("rel_path"), body.alias("raw"), error.alias("read_error"))


@query
def binary_by_content(spark, sf_dir):
    return status.binary_by_content(raw_documents(spark, sf_dir)).select("rel_path", "is_binary")


@query
def skip_status(spark, sf_dir):
    done = status.skip_status(raw_documents(spark, sf_dir))
    return done.select("rel_path", "is_binary", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"))


# --- secrets ----------------------------------------------------------------------------


@query
def secret_scan(spark, sf_dir):
    return secret_ops.secret_scan(views.corpus(spark, sf_dir))


@query
def secret_entropy(spark, sf_dir):
    """Every match of the rules that ask for entropy, with its entropy and the verdict."""
    docs = views.documents(spark, sf_dir)
    asking = [r for r in secrets.builtin_rules() if r.min_entropy > 0]

    def matches_of(rule: SecretRule):
        found = secrets.raw_matches("content", F.lit(secrets.java_pattern(rule.pattern)))
        facts = [F.lit(rule.name).alias("rule"), F.lit(rule.min_entropy).alias("least")]
        return F.transform(found, lambda m: F.struct(m["match_ord"].alias("match_ord"), m["text"].alias("text"), *facts))

    found = F.concat(*map(matches_of, asking))
    rows = docs.select("rel_path", F.explode_outer(found).alias("f")).where("f is not null").select("rel_path", "f.*")
    bits = secrets.shannon_entropy("text")
    return rows.select(
        "rel_path", "rule", "match_ord", F.round(bits, 6).alias("entropy"), (bits >= F.col("least") - 1e-9).alias("kept")
    )


@query
def secret_line(spark, sf_dir):
    """Lines of all assignments of a word to a quoted or bare value, wherever they start."""
    docs = views.documents(spark, sf_dir)
    found = F.explode_outer(secrets.raw_matches("content", F.lit(r"[A-Za-z_]+\s*[:=]\s*\S+"))).alias("f")
    return docs.select("rel_path", found).where("f is not null").select("rel_path", "f.match_ord", "f.line", md5_of("f.text"))


@query
def secret_redact(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(secrets.redact("text")).alias("digest"), secrets.redact("source").alias("short"))


@query
def secret_extra_rules(spark, sf_dir):
    found = secret_ops.secret_scan(views.corpus(spark, sf_dir), EXTRA_RULES)
    return found.groupBy("rel_path", "rule_ord", "rule").agg(F.count("*").alias("n"), long(F.max("line"), "last_line"))


@query
def secret_quarantine(spark, sf_dir):
    marked = secret_ops.secret_quarantine(secret_ops.with_findings(views.corpus(spark, sf_dir)))
    return marked.select("rel_path", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"), md5_of("content"))


@query
def findings_report(spark, sf_dir):
    return secret_ops.findings_report(secret_ops.secret_scan(views.corpus(spark, sf_dir)))


# --- cleaning ---------------------------------------------------------------------------


def cleaned(name: str, content: str, change: Callable, path: str = views.REL_PATH) -> None:
    def run(spark, sf_dir):
        docs = views.documents(spark, sf_dir, content, path)
        return docs.select("rel_path", change("content").alias("out")).select(
            "rel_path", F.octet_length("out").cast("long").alias("out_bytes"), md5_of("out")
        )

    run.__name__ = name
    query(run)


GO_PATH = "concat('d', cast(doc_id as varchar(20)), case cast(doc_id % 3 as int) when 0 then '.go' when 1 then '.swift' else '.txt' end)"

cleaned("strip_comments", views.COMMENTED, lambda c: cleaning.strip_comments("rel_path", c))
cleaned("strip_c_comments", views.COMMENTED, cleaning.strip_c_comments)
cleaned("strip_hash_comments", views.COMMENTED, cleaning.strip_hash_comments)
cleaned("strip_lua_comments", views.LUA_TEXT, cleaning.strip_lua_comments)
cleaned("strip_sql_comments", views.SQL_TEXT, cleaning.strip_sql_comments)


@query
def strip_xml_comments(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select("page_id", cleaning.strip_xml_comments("html").alias("out"))
    return pages.select("page_id", F.octet_length("out").cast("long").alias("out_bytes"), md5_of("out"))


cleaned("remove_empty_lines", f"concat(replace({views.CONTENT}, '. ', concat(chr(10), ' ', chr(10))), chr(10))", cleaning.remove_empty_lines)
cleaned("line_numbers", f"concat({views.CONTENT}, case when doc_id % 2 = 0 then chr(10) else '' end)", cleaning.line_numbers)
cleaned("truncate_base64", f"concat({views.CONTENT}, replace(replace(text, ' ', ''), chr(10), '/'))", cleaning.truncate_base64)
cleaned("compress_braces", views.BRACE_CODE, lambda c: cleaning.compress_braces("rel_path", c), GO_PATH)
cleaned("compress_python", views.PYTHON_CODE, cleaning.compress_python)


@query
def clean_documents(spark, sf_dir):
    corpus = views.corpus(spark, sf_dir, f"concat({views.COMMENTED}, {views.BRACE_CODE}, chr(10), repeat('B', 70))", GO_PATH)
    done = clean.clean_documents(
        corpus, remove_comments=True, truncate_base64=True, compress=True, remove_empty_lines=True, show_line_numbers=True
    )
    return done.select("rel_path", F.octet_length("content").cast("long").alias("out_bytes"), md5_of("content"))


# --- metrics ----------------------------------------------------------------------------


def measured(name: str, measure: Callable) -> None:
    def run(spark, sf_dir):
        return views.documents(spark, sf_dir).select("rel_path", long(measure("content"), "n"))

    run.__name__ = name
    query(run)


measured("tokens_ascii", tokens.tokens_ascii)
measured("tokens_unicode", tokens.tokens_unicode)
measured("estimate_tokens", tokens.estimate_tokens)
measured("count_chars", text.count_chars)
measured("count_lines", text.count_lines)


@query
def file_metrics(spark, sf_dir):
    return metrics.file_metrics(views.corpus(spark, sf_dir))


@query
def corpus_totals(spark, sf_dir):
    return metrics.corpus_totals(metrics.file_metrics(views.corpus(spark, sf_dir)))


@query
def top_files(spark, sf_dir):
    return metrics.top_files(metrics.file_metrics(views.corpus(spark, sf_dir)), 20)


@query
def run_report(spark, sf_dir):
    found = metrics.file_metrics(views.corpus(spark, sf_dir))
    totals = metrics.totals_report(metrics.corpus_totals(found)).withColumn("section", F.lit("totals"))
    return totals.unionByName(metrics.top_report(found, 10).withColumn("section", F.lit("top")))


@query
def token_listing(spark, sf_dir):
    return metrics.token_listing(metrics.file_metrics(views.corpus(spark, sf_dir)), 500)


@query
def token_ranks(spark, sf_dir):
    return metrics.token_ranks(metrics.file_metrics(views.corpus(spark, sf_dir)))


@query
def human_size(spark, sf_dir):
    parts = views.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * F.col("l_quantity")).cast("long")).alias("size")
    )
    sizes = parts.select("l_partkey", F.explode(F.array(F.col("size"), F.expr("size div 2000"), F.expr("size * 4096"))).alias("bytes"))
    return metrics.with_human_size(sizes)


# --- history ----------------------------------------------------------------------------


@query
def recent_commits(spark, sf_dir):
    return history.recent_commits(views.commits(spark, sf_dir), 200).select("hash", "author", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query
def change_freq(spark, sf_dir):
    return history.change_freq(views.commits(spark, sf_dir), views.commit_files(spark, sf_dir), 5000)


@query
def order_by_change_freq(spark, sf_dir):
    freq = history.change_freq(views.commits(spark, sf_dir), views.commit_files(spark, sf_dir), 0)
    return history.order_by_change_freq(views.parts(spark, sf_dir).select("rel_path"), freq)


@query
def rank_by_change_freq(spark, sf_dir):
    freq = history.change_freq(views.commits(spark, sf_dir), views.commit_files(spark, sf_dir), 0)
    return history.rank_by_change_freq(views.parts(spark, sf_dir).select("rel_path"), freq)


@query
def is_remote_url(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").selectExpr("page_id", f"{views.ADDRESS} as address")
    return pages.select("page_id", urls.is_remote_url("address").alias("is_remote"))


@query
def parse_repo_url(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").selectExpr("page_id", f"{views.ADDRESS} as address")
    return pages.select("page_id", urls.parse_repo_url("address").alias("spec")).select("page_id", "spec.*")


# --- trees ------------------------------------------------------------------------------


@query
def tree_nodes(spark, sf_dir):
    return tree.tree_nodes(views.documents(spark, sf_dir)).select("path", "parent", "name", long(F.col("depth"), "depth"), "is_dir")


@query
def tree_render(spark, sf_dir):
    return tree.tree_render(views.documents(spark, sf_dir)).select(F.replace("sort_key", F.lit("\0"), F.lit("|")).alias("sort_key"), "line")


@query
def tree_numbered(spark, sf_dir):
    return tree.tree_numbered(views.documents(spark, sf_dir)).select("line_no", "line")


@query
def tree_full(spark, sf_dir):
    """The tree of everything the rules leave, whatever the includes select for content."""
    docs = views.documents(spark, sf_dir)
    left = select.ignored_dir_prune(select.ignore_filter(docs, IGNORES), IGNORES)
    return tree.tree_render(left).select("line", F.replace("sort_key", F.lit("\0"), F.lit("|")).alias("sort_key"))


# --- rendering --------------------------------------------------------------------------


def marked_corpus(spark, sf_dir) -> DataFrame:
    """Fenced and terminator-laden texts; some files are skipped."""
    reason = F.when(F.col("is_binary"), fv.REASON_EXTENSION).when(F.col("rel_path").endswith(".log"), fv.REASON_SECRET)
    return views.corpus(spark, sf_dir, views.FENCED).withColumn("skip_reason", reason)


def rendered(style: str) -> None:
    def run(spark, sf_dir):
        out = render.render_files(marked_corpus(spark, sf_dir), style)
        return out.select(F.col("k_str").alias("rel_path"), F.octet_length("body").cast("long").alias("out_bytes"), md5_of("body"))

    run.__name__ = f"render_{style}"
    query(run)


for _style in ("xml", "markdown", "plain"):
    rendered(_style)


@query
def render_json(spark, sf_dir):
    """Rendered, and read back as JSON, since engines escape differently."""
    out = render.render_files(marked_corpus(spark, sf_dir), "json")
    parsed = F.from_json("body", "path string, content string, binary boolean, skipped string, bytes bigint")
    fields = out.select(parsed.alias("j")).select("j.*")
    return fields.select(
        "path", F.md5(F.coalesce("content", F.lit("-"))).alias("digest"), F.coalesce("binary", F.lit(False)).alias("binary"),
        F.coalesce("skipped", F.lit("")).alias("skipped"), "bytes",
    )


@query
def language_hint(spark, sf_dir):
    return views.documents(spark, sf_dir).select("rel_path", markup.language_hint("rel_path").alias("hint"))


@query
def render_summary(spark, sf_dir):
    totals = metrics.corpus_totals(metrics.file_metrics(views.corpus(spark, sf_dir)))
    out = [render.render_summary(totals, render.Options(style=s, generated_at=GENERATED)) for s in ("xml", "markdown", "plain", "json")]
    return reduce(DataFrame.unionByName, out)


def told_commits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    commits = views.table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as hash", "cast(o_custkey as string) as author",
        "date_format(o_orderdate, 'yyyy-MM-dd') as date",
        "concat(o_orderpriority, ' <', o_orderstatus, '>', chr(10), 'body') as message", "o_orderdate as ts",
    )
    return commits, views.commit_files(spark, sf_dir).select(F.col("hash").cast("string").alias("hash"), "path")


@query
def render_commit_log(spark, sf_dir):
    commits, touched = told_commits(spark, sf_dir)
    out = [
        render.render_commit_log(commits, touched, s).select(F.lit(s).alias("style"), "hash", "step", "path", "body")
        for s in ("xml", "markdown", "json", "plain")
    ]
    return reduce(DataFrame.unionByName, out)


@query
def assemble_sections(spark, sf_dir):
    corpus = marked_corpus(spark, sf_dir)
    totals = metrics.corpus_totals(metrics.file_metrics(corpus))
    sections = render.assemble_sections(corpus, totals, render.Options(style="plain", generated_at=GENERATED, header="head"))
    return sections.select(
        long(F.col("section_ord"), "section_ord"), F.replace("k_str", F.lit("\0"), F.lit("|")).alias("k_str"), md5_of("body")
    )


DIFF = "- a]]>\n+ b"


def two_roots(spark, sf_dir) -> DataFrame:
    """The marked corpus with a second root, in which some paths occur again."""
    corpus = marked_corpus(spark, sf_dir)
    again = corpus.where("left(md5(rel_path), 1) in ('0', '1')").withColumn("abs_path", F.concat(F.lit("/second/"), "rel_path"))
    return corpus.unionByName(again)


def assembled(style: str) -> None:
    """A whole document with header, diff, log and instruction, over paths that repeat."""

    def run(spark, sf_dir):
        corpus = two_roots(spark, sf_dir)
        totals = metrics.corpus_totals(metrics.file_metrics(corpus))
        commits, touched = told_commits(spark, sf_dir)
        log = commits.join(touched.groupBy("hash").agg(F.collect_list("path").alias("files")).hint("merge"), "hash", "left")
        options = render.Options(style=style, generated_at=GENERATED, header="a < b", instruction="do it", diffs={"work_tree": DIFF})
        body = F.col("body")
        if style == "json":  # files are compared as parsed values, with what stands around them
            j = F.from_json(F.regexp_extract(body, r"(?s)^    (\{.*\}),?\n$", 1), "path string, content string, binary boolean, skipped string, bytes bigint")
            parsed = F.concat_ws(
                "|", j["path"], F.coalesce(j["content"], F.lit("-")), j["skipped"], j["bytes"].cast("string"),
                F.coalesce(j["binary"], F.lit(False)).cast("string"), F.endswith(body, F.lit(",\n")).cast("string"),
            )
            body = F.when(F.col("section_ord") == 51, parsed).otherwise(body)
        sections = render.assemble_sections(corpus, totals, options, log=log)
        key = F.replace("k_str", F.lit("\0"), F.lit("|")).alias("k_str")
        return sections.select(long(F.col("section_ord"), "section_ord"), key, F.startswith("k_tie", F.lit("/second/")).alias("second"), F.md5(body.cast("binary")).alias("digest"))

    run.__name__ = f"assemble_{style}"
    query(run)


for _style in ("xml", "markdown", "json"):
    assembled(_style)


@query
def pack_corpus(spark, sf_dir):
    """A whole run: what it measures of the files it keeps, and how many secrets it found in the others."""
    packed = pack.pack_corpus(views.corpus(spark, sf_dir), render.Options(style="plain", generated_at=GENERATED))
    files = packed.metrics.select(F.lit("file").alias("kind"), "rel_path", "chars", "tokens", "lines", "bytes")
    none = [long(F.lit(0), c) for c in ("tokens", "lines", "bytes")]
    found = packed.findings.groupBy("rel_path").agg(F.count("*").alias("chars"))
    return files.unionByName(found.select(F.lit("finding").alias("kind"), "rel_path", "chars", *none))


def split_documents(spark, sf_dir) -> DataFrame:
    """All documents of a source, rendered as plain text by path, as one pack."""
    docs = views.table(spark, sf_dir, "documents").selectExpr("source", f"{views.REL_PATH} as rel_path", "text")
    body = markup.plain_file(F.col("rel_path"), F.col("text"))
    return split.split_packs(docs.select("source", "rel_path", body.alias("body")), SPLIT_BYTES, "source", ("rel_path",))


@query
def split_packs(spark, sf_dir):
    return split_documents(spark, sf_dir).select(
        "pack", "part_no", "n_parts", F.octet_length("content").cast("long").alias("part_bytes"), md5_of("content")
    )


@query
def part_filename(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return docs.select("rel_path", markup.part_filename("rel_path", F.col("doc_id") + 1).alias("file"))


@query
def write_packs(spark, sf_dir):
    location = f"{shared_folder(spark)}/packs-{uuid.uuid4().hex}"
    written = sinks.write_packs(split_documents(spark, sf_dir), location, "pack.txt")
    return sinks.file_digests(written, location)
