"""Rendered documents as rows.

A document is a DataFrame of sections::

    section_ord int, k_num bigint, k_str string, k_tie string, body string

Sorted by the first four columns, the bodies concatenate to the document. So a
document of any size stays distributed: it is sorted by range, written in order and
split without ever being one string. Every body ends a line except where a section
is a single value.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions import markup
from sheaf.functions.markup import text_concat
from sheaf.operators.history import touched_files
from sheaf.operators.joins import SALT, salted_lookup, salts_asked, spread_rows
from sheaf.operators.status import kept
from sheaf.operators.tree import tree_lines, tree_nodes

STYLES = ("xml", "markdown", "json", "plain")
EXTENSIONS = {"xml": ".xml", "markdown": ".md", "json": ".json", "plain": ".txt"}
ORDER = ("section_ord", "k_num", "k_str", "k_tie")

# Places in the document. JSON states its tree before its totals.
OPEN, SUMMARY, HEADER, TREE, JSON_STATS, FILES, DIFFS, LOG, INSTRUCTION, CLOSE = range(0, 100, 10)


@dataclass(frozen=True)
class Options:
    """What a document shows. ``generated_at`` is ``YYYY-MM-DDTHH:MM:SSZ``, given so that runs repeat."""

    style: str = "xml"
    tool_name: str = "sheaf"
    tool_version: str = "1.0.0"
    generated_at: str = "1970-01-01T00:00:00Z"
    header: str = ""
    instruction: str = ""
    summary: bool = True
    tree: bool = True
    files: bool = True
    diffs: dict[str, str] = field(default_factory=dict, hash=False)  # work_tree, staged

    @property
    def known_style(self) -> str:
        return self.style if self.style in STYLES else "xml"

    @property
    def producer(self) -> str:
        return f"{self.tool_name} v{self.tool_version}"

    @property
    def spoken_time(self) -> str:
        return self.generated_at.replace("T", " ").replace("Z", " UTC")


def _rows(
    df: DataFrame, place: int, body: Column, k_num: Column | int = 0, k_str: Column | str = "", k_tie: Column | str = ""
) -> DataFrame:
    num = k_num if isinstance(k_num, Column) else F.lit(k_num)
    key = k_str if isinstance(k_str, Column) else F.lit(k_str)
    tie = k_tie if isinstance(k_tie, Column) else F.lit(k_tie)
    return df.select(
        F.lit(place).alias("section_ord"),
        num.cast("long").alias("k_num"),
        key.alias("k_str"),
        tie.alias("k_tie"),
        body.alias("body"),
    )


def _one_row(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(0, 1, 1, 1)


def _stated(df: DataFrame, place: int, text: str) -> DataFrame:
    return _rows(_one_row(df), place, F.lit(text))


def _if_any(df: DataFrame, place: int, text: str) -> DataFrame:
    """One row with ``text`` if ``df`` has any row."""
    return _rows(df.limit(1), place, F.lit(text))


def _ends(df: DataFrame, key: str) -> DataFrame:
    """Flag the first and the last row by ``key`` (a struct or string); joins on one aggregated row."""
    ends = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    first = ends.select(F.col("_lo").alias(key), F.lit(True).alias("is_first"))
    last = ends.select(F.col("_hi").alias(key), F.lit(True).alias("is_last"))
    return df.join(F.broadcast(first), key, "left").join(F.broadcast(last), key, "left")


# --- single sections --------------------------------------------------------------------


def render_files(corpus: DataFrame, style: str = "xml") -> DataFrame:
    """One body per file. JSON shows skipped files with their reason, the others omit them."""
    path, content = F.col("rel_path"), F.col("content")
    if style == "json":
        body = markup.json_file(path, content, F.col("skip_reason"), F.col("is_binary"), F.col("bytes"))
        return corpus.select(*_file_keys(corpus), body.alias("body"))
    per_style = {"markdown": markup.markdown_file, "plain": markup.plain_file}
    body = per_style.get(style, markup.xml_file)(path, content)
    return kept(corpus).select(*_file_keys(corpus), body.alias("body"))


def _file_keys(corpus: DataFrame) -> list[Column]:
    changes = -F.col("n_changes") if "n_changes" in corpus.columns else F.lit(0)
    return [changes.cast("long").alias("k_num"), F.col("rel_path").alias("k_str"), F.col("abs_path").alias("k_tie")]


def summary_body(options: Options) -> Column:
    """The summary in one style, from the columns of ``corpus_totals``."""
    o = options
    files, chars, tokens, size = F.col("files"), F.col("chars"), F.col("tokens"), F.col("bytes")
    if o.known_style == "markdown":
        return text_concat(
            f"# {o.tool_name} Output\n\n> Packed by **{o.tool_name}** v{o.tool_version} at {o.spoken_time}\n\n"
            "| Metric | Value |\n|---|---|\n| Files | ", files, " |\n| Characters | ", chars,
            " |\n| Tokens (approx) | ", tokens, " |\n| Bytes | ", size, " |\n\n",
        )
    if o.known_style == "plain":
        rule = fv.PLAIN_RULE
        return text_concat(
            f"{rule}\nSUMMARY\n{rule}\nProducer:     {o.producer}\nGenerated at: {o.spoken_time}\nFiles:        ",
            files, "\nCharacters:   ", chars, "\nTokens (~):   ", tokens, "\nBytes:        ", size, "\n\n",
        )
    if o.known_style == "json":
        return text_concat('  "stats": ', F.to_json(F.struct("files", "chars", "tokens", "bytes")))
    return text_concat(
        "  <summary>\n    <producer>", markup.xml_text(F.lit(o.producer)), "</producer>\n    <generated_at>",
        markup.xml_text(F.lit(o.generated_at)), f"</generated_at>\n    <description>{fv.PACK_DESCRIPTION}</description>\n",
        '    <stats files="', files, '" chars="', chars, '" tokens="', tokens, '" bytes="', size, '"/>\n  </summary>\n',
    )


def render_summary(totals: DataFrame, options: Options) -> DataFrame:
    return totals.select(F.lit(options.known_style).alias("style"), summary_body(options).alias("body"))


HEAD, TOUCHED, TAIL = range(3)


#: Parts made of a log's two tables: styles of one log are made of one plan, for only then are its shuffles taken for equal.
_parts: WeakKeyDictionary[DataFrame, WeakKeyDictionary[DataFrame, dict[bool, DataFrame]]] = WeakKeyDictionary()


def _commit_parts(commits: DataFrame, files: DataFrame, style: str) -> DataFrame:
    """``commit_rows`` before they are rendered: what the bodies are made of, the same for all styles with files and for all without."""
    with_files = style not in ("markdown", "plain")
    made = _parts.setdefault(commits, WeakKeyDictionary()).setdefault(files, {})
    if with_files not in made:
        made[with_files] = _parts_with_files(commits, files) if with_files else _parts_without(commits)
    return made[with_files]


def _parts_without(commits: DataFrame) -> DataFrame:
    first_line = F.substring_index("message", "\n", 1).alias("message")
    return commits.select("ts", "hash", F.lit(HEAD).alias("step"), F.lit("").alias("path"), "date", first_line)


def _parts_with_files(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Files travel once to meet their commits; equal ones are counted there."""
    spread = spread_rows(files.select("hash", "path"), "hash", "path")
    first = spread.groupBy("hash").agg(F.min("path").alias("first_path"), salts_asked(SALT).alias("asked"))
    # both sides grow with the log; sizes on disk are no measure of what a broadcast takes in the driver
    known = commits.join(first.hint("merge"), "hash", "left")
    listed = spread.groupBy("hash", SALT, "path").agg(F.count("*").cast("int").alias("times"))
    touched = salted_lookup(listed, known.select("ts", "hash", "first_path", "asked"), "hash", "inner", "path", asked="asked")
    # a commit with a first path is asked for; naming both lets all readers of ``first`` share its shuffle
    has_files = F.col("first_path").isNotNull() & F.col("asked").isNotNull()
    told = ("author", "date", "message")
    ends = known.withColumn("step", F.explode(F.array(F.lit(HEAD), F.lit(TAIL)))).select(
        "ts", "hash", "step", F.lit("").alias("path"), *[F.when(F.col("step") == HEAD, F.col(c)).alias(c) for c in told],
        F.lit(None).cast("int").alias("times"), has_files.alias("opens"),
    )
    listing = touched.select(
        "ts", "hash", F.lit(TOUCHED).alias("step"), "path", *[F.lit(None).cast(commits.schema[c].dataType).alias(c) for c in told],
        "times", (F.col("path") == F.col("first_path")).alias("opens"),
    )
    return ends.unionByName(listing)


def _told(parts: DataFrame, style: str) -> DataFrame:
    """``_commit_parts`` rendered, in the order that they have."""
    if style in ("markdown", "plain"):
        named = ("- `", F.col("hash"), "` ") if style == "markdown" else (F.col("hash"), " ")
        return parts.select("ts", "hash", "step", "path", text_concat(*named, F.col("date"), " — ", F.col("message"), "\n").alias("body"))
    opens = F.col("opens")  # the list of files: for a file whether it is the first, else whether there is one
    if style == "json":
        text = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
        opened = F.regexp_replace(F.to_json(F.struct("hash", text("author"), text("date"), text("message"))), r"\}\z", "")
        head = F.concat(opened, F.when(opens, ',"files":[').otherwise(""))
        names = F.array_join(F.array_repeat(_json_text(F.col("path")), F.col("times")), ",")
        entry = F.concat(F.when(opens, "").otherwise(","), names)
        tail = F.when(opens, "]}").otherwise("}")
    else:
        head = text_concat(
            '    <commit hash="', markup.xml_attr("hash"), '">\n      <author>', markup.xml_text("author"),
            "</author>\n      <date>", markup.xml_text("date"), "</date>\n      <message>", markup.xml_text("message"),
            "</message>\n", F.when(opens, "      <files>\n").otherwise(""),
        )
        entry = F.repeat(text_concat("        <file>", markup.xml_text("path"), "</file>\n"), F.col("times"))
        tail = F.concat(F.when(opens, "      </files>\n").otherwise(""), F.lit("    </commit>\n"))
    body = F.when(F.col("step") == HEAD, head).when(F.col("step") == TOUCHED, entry).otherwise(tail)
    return parts.select("ts", "hash", "step", "path", body.alias("body"))


def commit_rows(commits: DataFrame, files: DataFrame, style: str) -> DataFrame:
    """Rendered commits as rows ``ts, hash, step, path, body``: a head, its files by path, a tail.

    ``commits`` has ``hash, author, date, message, ts`` and ``files`` has ``hash, path``. A commit is
    never gathered into one value, so one that touches very many files is only many rows. XML and JSON
    name author and files; Markdown and plain text are one row per commit.
    """
    return _told(_commit_parts(commits, files, style), style)


def render_commit_log(commits: DataFrame, files: DataFrame, style: str = "xml") -> DataFrame:
    """``commit_rows`` in the order of the document, latest commit first.

    Bodies are written after the sort: what is sorted is narrow, and styles of the same log in one query are sorted once.
    """
    parts = _commit_parts(commits, files, style).orderBy(F.desc("ts"), "hash", "step", "path")
    return _told(parts, style)


# --- whole documents --------------------------------------------------------------------


def _log_rows(log: DataFrame, style: str) -> DataFrame:
    """Commits with an array ``files`` as ``k_num, k_str, k_tie, body, step``."""
    rows = commit_rows(log.drop("files"), touched_files(log), style)
    key = F.concat("hash", F.lit("\0"), F.col("step").cast("string"), F.lit("\0"), "path")
    return rows.select((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("k_num"), key.alias("k_str"), F.lit("").alias("k_tie"), "body", "step")


def _log_section(log: DataFrame, style: str) -> DataFrame:
    return _rows(_log_rows(log, style), LOG + 1, F.col("body"), F.col("k_num"), F.col("k_str"))


def _tree_rows(tree: DataFrame, place: int, opening: str, closing: str, in_cdata: bool = False) -> DataFrame:
    """Tree lines between two texts, without a newline behind the last line."""
    lines = _ends(tree_lines(tree), "sort_key")
    line = markup.cdata_body(F.col("line")) if in_cdata else F.col("line")
    before = F.when(F.col("is_first"), "<![CDATA[" if in_cdata else "").otherwise("")
    after = F.when(F.col("is_last"), "]]>" if in_cdata else "").otherwise("\n")
    middle = _rows(lines, place + 1, text_concat(before, line, after), k_str=F.col("sort_key"))
    return _union([_stated(tree, place, opening), middle, _stated(tree, place + 2, closing)])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _xml_sections(corpus, tree, totals, log, o: Options) -> list[DataFrame]:
    out = [_stated(corpus, OPEN, f'<?xml version="1.0" encoding="UTF-8"?>\n<{o.tool_name}>\n')]
    if o.summary:
        out.append(_rows(totals, SUMMARY, summary_body(o)))
    if o.header:
        header = text_concat("  <user_header>", markup.xml_text(F.lit(o.header)), "</user_header>\n")
        out.append(_rows(_one_row(corpus), HEADER, header))
    if o.tree:
        out.append(_tree_rows(tree, TREE, "  <directory_structure>", "</directory_structure>\n", in_cdata=True))
    if o.files:
        out += [
            _if_any(corpus, FILES, "  <files>\n"),
            _file_rows(corpus, "xml"),
            _if_any(corpus, FILES + 2, "  </files>\n"),
        ]
    if any(o.diffs.values()):
        body = "".join(
            f"    <{kind}>{_cdata_text(o.diffs[kind])}</{kind}>\n" for kind in ("work_tree", "staged") if o.diffs.get(kind)
        )
        out.append(_stated(corpus, DIFFS, f"  <git_diffs>\n{body}  </git_diffs>\n"))
    if log is not None:
        out += [
            _if_any(log, LOG, "  <git_log>\n"),
            _log_section(log, "xml"),
            _if_any(log, LOG + 2, "  </git_log>\n"),
        ]
    if o.instruction:
        out.append(_stated(corpus, INSTRUCTION, f"  <instruction>{_cdata_text(o.instruction)}</instruction>\n"))
    return [*out, _stated(corpus, CLOSE, f"</{o.tool_name}>\n")]


def _cdata_text(text: str) -> str:
    return "<![CDATA[" + text.replace("]]>", "]]]]><![CDATA[>]]><![CDATA[") + "]]>" if text else ""


def _file_rows(corpus: DataFrame, style: str) -> DataFrame:
    return render_files(corpus, style).withColumn("section_ord", F.lit(FILES + 1)).select(*ORDER, "body")


def _text_sections(corpus, tree, totals, log, o: Options) -> list[DataFrame]:
    """Markdown and plain text share their build and differ in headings."""
    markdown = o.known_style == "markdown"

    def heading(name: str) -> str:
        return f"## {name}\n\n" if markdown else f"{fv.PLAIN_RULE}\n{name.upper()}\n{fv.PLAIN_RULE}\n"

    out = []
    if o.summary:
        out.append(_rows(totals, SUMMARY, summary_body(o)))
    if o.header:
        out.append(_stated(corpus, HEADER, heading("User Header") + o.header + "\n\n"))
    if o.tree:
        fence = "```\n" if markdown else ""
        end = "\n```\n\n" if markdown else "\n\n"
        out.append(_tree_rows(tree, TREE, heading("Directory Structure") + fence, end))
    if o.files:
        out.append(_if_any(corpus, FILES, heading("Files") + ("" if markdown else "\n")))
        out.append(_file_rows(corpus, o.known_style))
    titles = {"work_tree": "Working Tree", "staged": "Staged"}
    present = [k for k in titles if o.diffs.get(k)]
    if present and markdown:
        body = "".join(f"### {titles[k]}\n\n```diff\n{o.diffs[k]}\n```\n\n" for k in present)
        out.append(_stated(corpus, DIFFS, heading("Git Diffs") + body))
    elif present:
        body = "".join(heading(f"Git Diff ({titles[k]})") + o.diffs[k] + "\n\n" for k in present)
        out.append(_stated(corpus, DIFFS, body))
    if log is not None:
        out.append(_if_any(log, LOG, heading("Git Log")))
        out.append(_log_section(log, o.known_style))
        out.append(_if_any(log, LOG + 2, "\n"))
    if o.instruction:
        out.append(_stated(corpus, INSTRUCTION, heading("Instruction") + o.instruction + "\n"))
    return out


def _json_text(text: str | Column) -> Column:
    """A JSON string literal."""
    value = F.lit(text) if isinstance(text, str) else text
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1)


def _json_list(items: DataFrame, place: int, name: str) -> list[DataFrame]:
    """``"name": [...]`` from rows ``k_num, k_str, k_tie, body, begins, ends``, or nothing without rows.

    The three keys must name an item: paths may repeat over several roots, absolute paths do not. The list's
    first row must begin an item and its last row end one, so that only such rows are looked at for them.
    """
    keyed = items.withColumn("key", F.struct("k_num", "k_str", "k_tie"))
    last = keyed.where("ends").agg(F.max("key").alias("key")).withColumn("is_last", F.lit(True))
    keyed = keyed.join(F.broadcast(last), "key", "left")
    indent = F.when(F.col("begins"), "    ").otherwise("")
    after = F.when(F.col("is_last"), "\n").when(F.col("ends"), ",\n").otherwise("")
    rows = _rows(keyed, place + 1, text_concat(indent, F.col("body"), after), F.col("k_num"), F.col("k_str"), F.col("k_tie"))
    begun = items.where("begins")
    return [_if_any(begun, place, f',\n  "{name}": [\n'), rows, _if_any(begun, place + 2, "  ]")]


def _json_sections(corpus, tree, totals, log, o: Options) -> list[DataFrame]:
    one = _one_row(corpus)

    def field_of(place: int, name: str, text: str) -> DataFrame:
        return _rows(one, place, text_concat(f',\n  "{name}": ', _json_text(text)))

    out = [
        _rows(one, OPEN, text_concat('{\n  "producer": ', _json_text(o.producer))),
        field_of(OPEN + 1, "generated_at", o.generated_at),
    ]
    if o.header:
        out.append(field_of(HEADER, "header_text", o.header))
    if o.tree:
        lines = _ends(tree_lines(tree), "sort_key")
        inner = F.regexp_replace(_json_text(F.col("line")), r'\A"|"\z', "")
        first = F.when(F.col("is_first"), ',\n  "directory_tree": "').otherwise("")
        last = F.when(F.col("is_last"), '"').otherwise("\\n")
        out.append(_rows(lines, TREE, text_concat(first, inner, last), k_str=F.col("sort_key")))
    out.append(_rows(totals, JSON_STATS, text_concat(",\n", summary_body(o))))
    if o.files:
        whole = render_files(corpus, "json").withColumn("begins", F.lit(True)).withColumn("ends", F.lit(True))
        out += _json_list(whole, FILES, "files")
    for place, kind, name in ((DIFFS, "work_tree", "git_diff_worktree"), (DIFFS + 1, "staged", "git_diff_staged")):
        if o.diffs.get(kind):
            out.append(field_of(place, name, o.diffs[kind]))
    if log is not None:
        items = _log_rows(log, "json")
        items = items.withColumn("begins", F.col("step") == HEAD).withColumn("ends", F.col("step") == TAIL)
        out += _json_list(items, LOG, "git_log")
    if o.instruction:
        out.append(field_of(INSTRUCTION, "instruction", o.instruction))
    return [*out, _stated(corpus, CLOSE, "\n}\n")]


def assemble_sections(
    corpus: DataFrame,
    totals: DataFrame,
    options: Options,
    tree_files: DataFrame | None = None,
    log: DataFrame | None = None,
) -> DataFrame:
    """All sections of a document, unsorted.

    ``corpus`` may carry ``n_changes`` and is then ordered by it. ``tree_files`` are the
    paths of the tree if they are not those of the corpus; ``log`` has ``hash, author,
    date, message, files, ts``. An unknown style means XML.
    """
    tree = tree_nodes(corpus if tree_files is None else tree_files) if options.tree else corpus
    build = {"json": _json_sections, "xml": _xml_sections}.get(options.known_style, _text_sections)
    return _union(build(corpus, tree, totals, log, options))


def in_order(sections: DataFrame) -> DataFrame:
    return sections.orderBy(*ORDER)
