"""Line deduplication with a log-template tree.

The tree has a fixed depth: a line descends by its number of tokens, then by its
first ``DEPTH`` tokens, where variable fields (tokens with digits, addresses) read
as ``<*>``. A leaf that fewer than ``MIN_DOCS`` documents reach holds nothing that
recurs and is dropped from the work. In the others each position of the lines is
looked at: a token that at least ``MIN_DOCS`` documents have there is constant,
any other is one more variable field. The constants in their positions are the
line's template. A template recurs if at least ``MIN_DOCS`` documents have a line
of it; all its lines are then dropped from the texts. So that lines which merely
start alike stay, a template must fix half of its positions and agree (by constant
or recognised field) on ``AGREE`` of them. Lines that ``MIN_DOCS`` documents have word
for word are dropped too, whatever their share of fields.

Everything is counted with grouped sums over hashes of tokens, so a leaf of any
size spreads over tasks; nothing depends on the order of lines.

Inputs: null text has no lines and stays null; lines without a token are kept.
Lines of any length are parsed whole. Rows that repeat both id and text are one
document where the documents of a template are counted. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_hot, materialize, slices
from tessera.llm.substring_dedup import words_of

DEPTH, MIN_DOCS, AGREE, FIXED = 3, 5, 0.8, 0.5
FIELD = "<*>"
_DIGIT = re.compile(r"[0-9]")
_VARIABLE = re.compile(r"[0-9]|://|^www\.|^\S+@\S+\.\S+$")
_FIELD_CODE = words_of(FIELD.encode())[1][0]


def _maybe(line: str) -> bool:
    """Whether a line may hold a field."""
    return _DIGIT.search(line) is not None or "@" in line or "://" in line or "www." in line


def tokens_of(line: str) -> list[str]:
    words = line.split()
    return [FIELD if _VARIABLE.search(w) else w for w in words] if _maybe(line) else words


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def token_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of each line (joined by spaces) begin, and the tokens' hashes; those of fields are -1."""
    raws = [line.encode() for line in lines]
    starts, codes = words_of(b" ".join(raws))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)])).astype(np.int32)
    return bounds, np.where(codes == _FIELD_CODE, -1, codes >> np.uint64(33)).astype(np.int32)


def _codes(line: str) -> tuple[int, int, int, str] | None:
    """Hashes of the leaf, the line with its fields masked and the line as it is, and the tokens joined by spaces; None of a line without any."""
    words = line.split()
    if not words:
        return None
    parts = tokens_of(line) if _maybe(line) else words
    joined = " ".join(parts)
    code = _hash(joined)
    return _hash(f"{len(parts)} {' '.join(parts[:DEPTH])}"), code, code if parts is words or parts == words else _hash(" ".join(words)), joined


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line (kind 0) and one with the tokens of each distinct line of a batch (kind 1)."""
    for whole in batches:
        for batch in slices(whole, "text"):
            known: dict[int, int] = {}
            lines: dict[str, tuple[int, int, int] | None] = {}  # those that were seen
            rows: list[tuple] = []
            sizes, fresh = [], []
            for text in batch.column("text").to_pylist():
                leaves, own, before = set(), set(), len(rows)
                for number, line in enumerate(text.split("\n")) if text else ():
                    if line in lines:
                        codes = lines[line]
                        if codes is None:
                            continue
                        leaf, code, raw = codes
                    else:
                        codes = _codes(line)
                        if codes is None:
                            lines[line] = None
                            continue
                        leaf, code, raw, joined = codes
                        lines[line] = leaf, code, raw
                        if code not in known:
                            known[code] = leaf
                            fresh.append(joined)
                    rows.append((number, leaf, code, raw, leaf not in leaves, code not in own))
                    leaves.add(leaf)
                    own.add(code)
                sizes.append(len(rows) - before)
            n, m = len(rows), len(known)
            number, leaf, code, raw, in_leaf, in_line = zip(*rows) if rows else [()] * 6
            document = pa.array(np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n)
            blank = lambda kind: pa.nulls(m, kind)
            listed = pa.ListArray.from_arrays(*map(pa.array, token_hashes(fresh)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([0, 1], np.int32), [n, m])),
                    batch.column("doc_id").take(document),
                    batch.column("mark").take(document),
                    pa.concat_arrays([pa.array(number, pa.int32()), blank(pa.int32())]),
                    pa.array(np.array([*leaf, *known.values()], np.int64)),
                    pa.array(np.array([*code, *known], np.int64)),
                    pa.concat_arrays([pa.array(raw, pa.int64()), blank(pa.int64())]),
                    pa.concat_arrays([pa.array(in_leaf, pa.bool_()), blank(pa.bool_())]),
                    pa.concat_arrays([pa.array(in_line, pa.bool_()), blank(pa.bool_())]),
                    pa.concat_arrays([pa.nulls(n, listed.type), listed]),
                ],
                ["kind", "doc_id", "mark", "number", "leaf", "code", "raw", "in_leaf", "in_line", "tokens"],
            )


def _parsed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    schema = "kind int, doc_id long, mark long, number int, leaf long, code long, raw long, in_leaf boolean, in_line boolean, tokens array<int>"
    return materialize(rows.mapInArrow(_parse, schema), "lines", "kind")


def _exact(parsed: DataFrame, min_docs: int) -> DataFrame:
    """doc_id, mark and number of every line that recurs word for word."""
    lines = parsed.where("kind = 0").select("doc_id", "mark", "number", "raw")
    often = lines.select("raw", "doc_id", "mark").distinct().groupBy("raw").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    sizes = materialize(lines.groupBy("raw").agg(F.count("*").alias("n")).join(often, "raw"), "exact-lines")
    return join_hot(lines, sizes.select("raw", "n"), ["raw"], "n", lines.count()).select("doc_id", "mark", "number")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, mark (hash of the text), number and template of every line whose template recurs."""
    return _recurring(_parsed(docs), min_docs)


def _recurring(parsed: DataFrame, min_docs: int) -> DataFrame:
    lines = parsed.where("kind = 0").select("doc_id", "mark", "number", "leaf", "code", "in_leaf", "in_line")
    live = lines.where("in_leaf").groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    live, total = materialize(live, "live-leaves"), lines.count()
    counts = join_hot(lines.where("in_line").select("leaf", "code"), live, ["leaf"], "docs", total).groupBy("leaf", "code").agg(F.count("*").alias("n"))
    texts = join_hot(parsed.where("kind = 1").select("leaf", "code", "tokens"), live, ["leaf"], "docs", total).groupBy("leaf", "code").agg(F.first("tokens").alias("tokens"))
    distinct = materialize(texts.join(counts, ["leaf", "code"]), "live-lines")
    fields = distinct.select("leaf", "code", "n", F.posexplode("tokens").alias("at", "token"))
    fixed = fields.where("token >= 0").groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("leaf", "at", "token")
    shape = fields.join(fixed, ["leaf", "at", "token"]).groupBy("leaf", "code").agg(F.count("*").alias("fixed"), F.bit_xor(F.xxhash64("at", "token")).alias("constants"))
    size, masked = F.size("tokens"), F.size(F.filter("tokens", lambda t: t < 0))
    shaped = distinct.join(shape, ["leaf", "code"]).where((F.col("fixed") >= FIXED * size) & (F.col("fixed") + masked >= AGREE * size))
    templates = materialize(shaped.select("leaf", "code", "n", F.xxhash64("leaf", "constants").alias("template")), "shapes")
    found = materialize(join_hot(lines.drop("in_leaf", "in_line"), templates, ["leaf", "code"], "n", total).drop("n"), "templates")
    often = found.select("template", "doc_id", "mark").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    return join_hot(found, materialize(often, "recurring"), ["template"], "docs", total).select("doc_id", "mark", "number", "template")


def deduplicate(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text without its recurring lines, n_lines (\\n-split) and n_dropped, of every row."""
    parsed = _parsed(docs)
    drop = _recurring(parsed, min_docs).select("doc_id", "mark", "number").unionByName(_exact(parsed, min_docs)).groupBy("doc_id", "mark").agg(F.collect_set("number").alias("numbers"))
    drop = drop.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), "numbers")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    joined = rows.join(drop, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")), "left")
    lines = F.split("text", "\n", -1)
    none = F.array().cast("array<int>")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.coalesce("numbers", none), i))
    text = F.when(F.col("numbers").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select("doc_id", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("n_dropped"))
