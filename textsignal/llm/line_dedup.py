"""Line deduplication by log templates: recurring templates are dropped after their first document."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsignal.llm.common import renamed, slices
from textsignal.sources.tables import cut_lineage

DEPTH = 3  # leading tokens that name a leaf, below the token count
MIN_TOKENS = 1  # lines of white space alone have no template and are kept
MIN_DOCS = 4  # documents that make a leaf, a token or a template recurring
CONSTANT = 0.8  # share of a template's tokens that must not be variable
SHORT = 9  # tokens up to which a template whose variable fields all have digits needs only the next two
SHORT_CONSTANT = 0.5  # share of such a template's tokens that must not be variable
SHORT_LEAST = 2  # and their number
VARIABLE = "<*>"
_DIGIT = re.compile(r"\d")
# scripts without blanks: Thai, Lao, Burmese, Khmer, kana, Han
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED, _PART = re.compile(f"[{UNSPACED}]"), re.compile(rf"\d+|[{UNSPACED}]|[^\s\d{UNSPACED}]+")


def split(line: str) -> list[str]:
    """Tokens between white space; a token in a script without blanks gives its characters, its numbers and the rest."""
    if line.isascii() or not _UNSPACED.search(line):
        return line.split()
    return [p for t in line.split() for p in (_PART.findall(t) if _UNSPACED.search(t) else [t])]


def masked(line: str) -> list[str]:
    """Tokens of a line; one with a digit is a variable field."""
    return [VARIABLE if _DIGIT.search(t) else t for t in split(line)]


def _hash(parts: list[str]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def identity(key: Column, text: Column) -> Column:
    """One number for an id with its text: rows that repeat both are treated alike."""
    return F.xxhash64(key, text)


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line with a template: its leaf, its masked tokens' hash, its own hash if it has a digit, and whether its document has each for the first time."""

    def run(batches):
        for b in slices(batches):
            uid, line, leaf, whole, exact, new_leaf, new_whole, new_exact = ([] for _ in range(8))
            for key, text in zip(b.column("uid").to_pylist(), b.column("text").to_pylist()):
                seen = set()
                for i, part in enumerate((text or "").split("\n")):
                    digit = _DIGIT.search(part)
                    tokens = masked(part) if digit else split(part)
                    if len(tokens) < MIN_TOKENS:
                        continue
                    a, w = _hash([str(len(tokens)), *tokens[:DEPTH]]), _hash(tokens)
                    e = _hash(part.split()) if digit else None
                    uid.append(key)
                    line.append(i)
                    leaf.append(a)
                    whole.append(w)
                    exact.append(e)
                    new_leaf.append((0, a) not in seen)
                    new_whole.append((1, w) not in seen)
                    new_exact.append(e is not None and (2, e) not in seen)
                    seen.update(((0, a), (1, w), (2, e)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(line, pa.int32()), pa.array(leaf, pa.int64()), pa.array(whole, pa.int64()),
                 pa.array(exact, pa.int64()), pa.array(new_leaf, pa.bool_()), pa.array(new_whole, pa.bool_()), pa.array(new_exact, pa.bool_())],
                ["uid", "line", "leaf", "whole", "exact", "new_leaf", "new_whole", "new_exact"],
            )

    return docs.select("uid", "text").mapInArrow(
        run, "uid long, line int, leaf long, whole long, exact long, new_leaf boolean, new_whole boolean, new_exact boolean"
    )


def _tokens(rows: DataFrame) -> DataFrame:
    """The masked tokens of one line of a text."""

    def run(batches):
        for b in slices(batches):
            made = [masked(t.split("\n")[i]) for t, i in zip(b.column("text").to_pylist(), b.column("line").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("leaf"), b.column("whole"), b.column("docs"), pa.array(made, pa.list_(pa.string()))],
                ["leaf", "whole", "docs", "tokens"],
            )

    return rows.select("leaf", "whole", "docs", "line", "text").mapInArrow(
        run, "leaf long, whole long, docs long, tokens array<string>"
    )


def equal_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with a digit that ``MIN_DOCS`` documents have token for token, but for their first document: ``uid, line``."""
    often = lines.filter("exact IS NOT NULL").groupBy("exact").agg(F.count_if("new_exact").alias("n")).filter(F.col("n") >= MIN_DOCS)
    found = cut_lineage(lines.join(often.select("exact"), "exact").select("exact", "uid", "line"), "equal")
    spread = found.select("exact", "uid").distinct().join(docs.select("key", "uid"), "uid").groupBy("exact").agg(
        F.count("*").alias("docs"), F.min(F.struct("key", "uid")).alias("first")
    )
    kept = spread.filter(F.col("docs") >= MIN_DOCS).select("exact", F.col("first.uid").alias("kept"))
    return found.join(kept, "exact").filter("uid <> kept").select("uid", "line")


def templates(docs: DataFrame, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Line occurrences with their template, and the templates: ``template, pattern, constant, size, unspaced, strict, docs, first``.

    The tree has a fixed depth: token count, then the leading tokens. In a leaf, a token is constant
    where it stands at the same place in lines of ``MIN_DOCS`` documents, and a variable field
    elsewhere. That is counted, not searched, so it depends on no order and no leaf is ever in one task.
    ``strict`` tells that only tokens with a digit are variable, ``unspaced`` that characters are tokens.
    ``docs`` needs ``key``, ``uid`` and ``text``. Only leaves of ``MIN_DOCS`` documents go on.
    """
    lines = cut_lineage(_lines(docs), "lines") if lines is None else lines
    leaves = cut_lineage(
        lines.groupBy("leaf").agg(F.count_if("new_leaf").alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf"), "leaves"
    )
    met = cut_lineage(lines.join(leaves, "leaf"), "met")
    distinct = met.groupBy("leaf", "whole").agg(
        F.count_if("new_whole").alias("docs"), F.min(F.struct("uid", "line")).alias("one")
    )
    sample = cut_lineage(distinct.select("leaf", "whole", "docs", F.col("one.uid").alias("uid"), F.col("one.line").alias("line")), "sample")
    texts = docs.select("uid", "text").hint("merge")  # the same plan at every size
    tokens = cut_lineage(_tokens(sample.join(texts, "uid")).dropDuplicates(["leaf", "whole"]), "tokens")
    placed = tokens.select("leaf", "whole", "docs", F.posexplode("tokens").alias("at", "token"))
    constant = placed.filter(F.col("token") != VARIABLE).groupBy("leaf", "at", "token").agg(
        F.sum("docs").alias("n")).filter(F.col("n") >= MIN_DOCS).drop("n")
    shown = (
        placed.join(constant.withColumn("kept", F.lit(True)), ["leaf", "at", "token"], "left")
        .groupBy("leaf", "whole").agg(
            F.sort_array(F.collect_list(F.struct("at", F.when(F.col("kept"), F.col("token")).otherwise(VARIABLE).alias("token")))).alias("t"),
            F.avg(F.when(F.col("kept"), 1.0).otherwise(0.0)).alias("constant"), F.count("*").alias("size"),
            F.max(F.col("token").rlike(f"^[{UNSPACED}]$")).alias("unspaced"),
            F.min(F.col("kept").isNotNull() | (F.col("token") == VARIABLE)).alias("strict"),
        ).select("leaf", "whole", F.array_join("t.token", " ").alias("pattern"), "constant", "size", "unspaced", "strict")
        .withColumn("template", F.xxhash64("leaf", "pattern"))
    )
    shown = cut_lineage(shown, "shown")
    found = met.join(shown.select("leaf", "whole", "template"), ["leaf", "whole"]).select("uid", "line", "template")
    found = cut_lineage(found, "found")
    keys = docs.select("key", "uid")
    spread = found.select("template", "uid").distinct().join(keys, "uid").groupBy("template").agg(
        F.count("*").alias("docs"), F.min(F.struct("key", "uid")).alias("first")
    )
    named = shown.groupBy("template").agg(
        F.min("pattern").alias("pattern"), F.min("constant").alias("constant"), F.min("size").alias("size"),
        F.max("unspaced").alias("unspaced"), F.min("strict").alias("strict"),
    )
    return found, cut_lineage(named.join(spread, "template"), "templates")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns with the text shortened, ``n_lines`` and ``n_dropped`` (columns of those names are replaced).

    A line (text between line feeds) is dropped where its template is in ``MIN_DOCS`` documents or
    more, at least ``CONSTANT`` of the template's tokens are constant, and the document isn't the first,
    by id, that has the template. For templates of ``SHORT`` tokens at most whose variable fields all have
    digits, ``SHORT_CONSTANT`` of the tokens and ``SHORT_LEAST`` of them are enough. A line with a digit that
    ``MIN_DOCS`` documents have token for token is dropped but from the first of them, whatever its template. In scripts without blanks characters are tokens, and only those with a
    digit may be variable; without such fields 1 to 4 tokens must all be constant. White space alone stays. Other lines keep
    their order and bytes. Null text stays null, with 0 lines. Null id: before all others. Rows
    that repeat id and text are one document for the count, and lose the same lines; rows that repeat
    an id alone are documents of their own, first the one with the smaller hash. Empty table: no rows.
    """
    plain, at = renamed(docs)
    uid = identity(F.col(at[id_col]), F.col(at[text_col]))
    rows = plain.select(F.col(at[id_col]).alias("key"), uid.alias("uid"), F.col(at[text_col]).cast("string").alias("text"))
    lines = cut_lineage(_lines(rows), "lines")
    found, made = templates(rows, lines)
    share = F.col("constant")
    sure = (share >= CONSTANT) & (F.col("strict") | ~F.col("unspaced"))
    sure |= F.col("strict") & (F.col("size") <= SHORT) & (share >= SHORT_CONSTANT) & (F.round(share * F.col("size")) >= SHORT_LEAST)
    gone = made.filter((F.col("docs") >= MIN_DOCS) & sure).select("template", F.col("first.uid").alias("kept"))
    dropped = cut_lineage(
        found.join(gone, "template").filter("uid <> kept").select("uid", "line").union(equal_lines(rows, lines)).groupBy("uid").agg(F.collect_set("line").alias("gone")), "dropped"
    )
    names = [f"c{i}" for i, c in enumerate(docs.columns) if c.lower() not in ("n_lines", "n_dropped")]
    text = at[text_col]
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}

    def run(batches):
        for b in slices(batches):
            texts, lines, n = [], [], []
            for own, drop in zip(b.column(text).to_pylist(), b.column("_gone").to_pylist()):
                parts = (own or "").split("\n") if own is not None else []
                drop = set(drop or ())
                texts.append("\n".join(p for i, p in enumerate(parts) if i not in drop) if drop else own)
                lines.append(len(parts))
                n.append(len(drop))
            columns = [pa.array(texts, pa.string()) if c == text else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int32()), pa.array(n, pa.int32())], [*names, "n_lines", "n_dropped"]
            )

    joined = plain.withColumn("_uid", uid).hint("merge").join(
        dropped.select(F.col("uid").alias("_uid"), F.col("gone").alias("_gone")), "_uid", "left"
    ).drop("_uid")
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", n_lines int, n_dropped int"
    out = joined.mapInArrow(run, schema)
    return out.toDF(*[docs.columns[int(c[1:])] for c in names], "n_lines", "n_dropped")
