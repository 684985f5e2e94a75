"""Column expressions for text: cleaning, stripping, truncation, templates,
step splitting, sliding windows and short-part merging.

Built-in Spark SQL expressions, which stay in the JVM, except the sliding
windows and the step merge: as folds they are quadratic in the text, so they are
linear Arrow UDFs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

# Python's str.strip()/\s set of whitespace code points (it also covers
# U+001C..U+001F, which Java's (?U)\s does not).  Same class text works in
# Java regex and RE2.
WS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
STRIP_PATTERN = r"\A" + WS + r"+|" + WS + r"+\z"

# Zero-width split before each step marker.
STEP_SPLIT_PATTERN = "(?U)(?=" + "|".join(m.replace(r"\s", WS) for m in C.STEP_MARKERS) + ")"

# Math spans in delimiter priority order; lazy bodies.
MATH_SPAN_PATTERN = (r"\$\$[\s\S]*?\$\$|\$[\s\S]*?\$|\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def absent(c) -> Column:
    """Python truthiness of an optional string: None and '' are absent."""
    return F.coalesce(col_(c), F.lit("")) == ""


def present(c) -> Column:
    return ~absent(c)


def strip(c) -> Column:
    """str.strip(): remove Unicode whitespace on both ends (null stays null)."""
    return F.regexp_replace(col_(c), STRIP_PATTERN, "")


def is_blank(c) -> Column:
    """`s.strip() == ''` (null counts as blank)."""
    return F.coalesce(strip(c), F.lit("")) == ""


def clean_text(c) -> Column:
    """Corpus cleaner: absent -> '', CRLF -> LF, 3+ LF -> 2, and outside
    `$...$` spans runs of 2+ spaces become one.  No trimming."""
    x = F.coalesce(col_(c), F.lit(""))
    x = F.replace(x, F.lit("\r\n"), F.lit("\n"))
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    # a math span is kept as is (group 1); a space run keeps one space (group 2)
    return F.regexp_replace(x, r"(\$[^$]*\$)|( ) +", "$1$2")


def truncate(c, limit: int, keep: int | None = None, suffix: str = "") -> Column:
    """`x if len(x) <= limit else x[:keep] + suffix` (keep defaults to limit)."""
    x = col_(c)
    keep = limit if keep is None else keep
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, keep), F.lit(suffix))).otherwise(x)


def prefix(c, n: int) -> Column:
    """`x[:n]`."""
    return F.substring(col_(c), 1, n)


def chat_text(query, response, system_prompt: str = C.SYSTEM_PROMPT_VI) -> Column:
    return F.concat(F.lit("[SYS]" + system_prompt + "[/SYS][USR]"), col_(query),
                    F.lit("[/USR][AST]"), col_(response), F.lit("[/AST][EOS]"))


def inference_prompt(query, system_prompt: str = C.SYSTEM_PROMPT_VI) -> Column:
    return F.concat(F.lit("[SYS]" + system_prompt + "[/SYS][USR]"), col_(query), F.lit("[/USR][AST]"))


def has_template_tags(text) -> Column:
    """All required tags are present (`[/AST]` and `[EOS]` are not required)."""
    t = col_(text)
    cond = F.lit(True)
    for tag in C.TEMPLATE_REQUIRED:
        cond = cond & F.coalesce(F.contains(t, F.lit(tag)), F.lit(False))
    return cond


def math_spans(text) -> Column:
    """array<string> of math spans, left to right, `$$` tried before `$`."""
    return F.regexp_extract_all(col_(text), F.lit(MATH_SPAN_PATTERN), 0)


def solution_steps(response) -> Column:
    """Split before every step marker, strip the parts, drop empty ones."""
    parts = F.split(F.coalesce(col_(response), F.lit("")), STEP_SPLIT_PATTERN, -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def window_bounds(texts: list[str], size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the windows of all texts, by text and start.

    A window holds `size` characters; unless it reaches the end of its text, it ends
    after the last sentence end that lies past half of it.  The next one starts
    `overlap` characters before that, until a start lies at the end of the text or
    beyond (so the last window may be a short tail of the one before it).

    All texts advance together, a window each at a time: sentence ends are looked up
    in one sorted array, so the work is linear in the characters."""
    width = len(C.SENTENCE_ENDS[0])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(lengths) - lengths
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.zeros(max(len(chars) - width + 1, 0), dtype=bool)
    for marker in C.SENTENCE_ENDS:
        found |= np.logical_and.reduce([chars[k:len(found) + k] == ord(c) for k, c in enumerate(marker)])
    marks = np.flatnonzero(found)
    texts_at, starts, ends = [], [], []
    live = np.flatnonzero(lengths > 0)
    start = base[live]
    while len(live):
        limit = base[live] + lengths[live]
        end = np.minimum(start + size, limit)
        if len(marks):
            last = marks[np.maximum(np.searchsorted(marks, start + size - width, side="right") - 1, 0)]
            inside = (start + size < limit) & (last > start + size // 2) & (last <= start + size - width)
            end = np.where(inside, last + 1, end)
            step = np.where(inside, last + 1, start + size) - overlap
        else:
            step = start + size - overlap
        texts_at.append(live)
        starts.append(start - base[live])
        ends.append(end - base[live])
        going = step < limit
        live, start = live[going], step[going]
    if not texts_at:
        return (np.zeros(0, dtype=np.int64),) * 3
    at, lo, hi = np.concatenate(texts_at), np.concatenate(starts), np.concatenate(ends)
    order = np.lexsort((lo, at))
    return at[order], lo[order], hi[order]


def _list_offsets(owners: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n lists from the sorted list numbers of their elements."""
    return np.searchsorted(owners, np.arange(n + 1)).astype(np.int32)


def _lists(offsets: np.ndarray, values: pa.Array, null: np.ndarray) -> pa.ListArray:
    """Lists of values; those marked null (which hold none) become null."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(null))


SLICE_BYTES = 4_000_000        # texts of a batch handled at once (a longer text is a slice of its own)


def row_slices(column: pa.Array, max_bytes: int | None = None) -> list[tuple[int, int]]:
    """(first row, rows) of slices of a text column of bounded bytes, so that what a UDF holds
    besides its batch does not grow with the lengths of the texts; one of no rows for none."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, lo = [], 0
    while lo < len(column):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + (max_bytes or SLICE_BYTES), side="right")))
        out.append((lo, hi - lo))
        lo = hi
    return out or [(0, 0)]


def sliding_windows(text, size: int = C.WINDOW, overlap: int = C.OVERLAP) -> Column:
    """array<struct<start:int, text:string>> of the raw windows (not stripped);
    null for a null text.  An Arrow UDF: a fold of SQL expressions reads the text
    from its start for every window, which is quadratic in its length."""
    if overlap >= size // 2 + 2:
        raise ValueError("the overlap must leave room to move on")

    def windows_of(column: pa.Array) -> pa.Array:
        texts = column.fill_null("").to_pylist()
        at, lo, hi = window_bounds(texts, size, overlap)
        cut = [texts[t][a:b] for t, a, b in zip(at.tolist(), lo.tolist(), hi.tolist())]
        rows = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(cut, pa.string())], ["start", "text"])
        return _lists(_list_offsets(at, len(texts)), rows, column.is_null().to_numpy(zero_copy_only=False))

    @F.arrow_udf("array<struct<start:int, text:string>>")
    def windows(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([windows_of(column.slice(lo, n)) for lo, n in row_slices(column)])
    return windows(col_(text))


def merge_short(parts: pa.Array, offsets: np.ndarray, min_part: int) -> tuple[pa.Array, np.ndarray]:
    """Lists of parts, given by offsets, with every part shorter than `min_part` glued
    by a space to the one before it in its list; returns parts and offsets.

    A part that is long enough, or the first of its list, begins a group; the groups
    are joined all at once."""
    begins = pc.utf8_length(parts).to_numpy(zero_copy_only=False) >= min_part
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    heads = np.flatnonzero(begins)
    groups = pa.ListArray.from_arrays(pa.array(np.append(heads, len(parts)), pa.int32()), parts)
    return pc.binary_join(groups, " "), np.searchsorted(heads, offsets).astype(np.int32)


def steps_for_response(response_name: str, size: int = C.WINDOW, overlap: int = C.OVERLAP,
                       min_part: int = C.MIN_PART, split_name: str | None = None) -> Column:
    """Final solution steps of the column named `response_name`: marker split,
    or the stripped windows of the raw text when the split yields at most one
    part; then the short-part merge.  Linear in the text; null for a null text.

    `split_name` names a column that already holds `solution_steps(response)`."""
    split = F.col(split_name) if split_name else solution_steps(F.col(response_name))

    def steps_of(splits: pa.Array, column: pa.Array) -> pa.Array:
        null = column.is_null().to_numpy(zero_copy_only=False)
        sizes = splits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(sizes) - sizes                 # of each row's parts in the flat array
        rows = np.flatnonzero((sizes <= 1) & ~null)      # cut into windows instead
        texts = column.take(pa.array(rows)).to_pylist()
        at, lo, hi = window_bounds(texts, size, overlap)
        cut = [texts[t][a:b].strip() for t, a, b in zip(at.tolist(), lo.tolist(), hi.tolist())]
        flat = pa.concat_arrays([splits.flatten().cast(pa.string()), pa.array(cut, pa.string())])
        offsets = _list_offsets(at, len(rows))
        first[rows] = len(flat) - len(cut) + offsets[:-1]
        sizes[rows] = np.diff(offsets)
        sizes[null] = 0
        ends = np.concatenate(([0], np.cumsum(sizes)))
        parts = flat.take(pa.array(np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])))
        glued, ends = merge_short(parts, ends, min_part)
        return _lists(ends, glued, null)

    @F.arrow_udf("array<string>")
    def steps(splits: pa.Array, column: pa.Array) -> pa.Array:
        return pa.concat_arrays([steps_of(splits.slice(lo, n), column.slice(lo, n)) for lo, n in row_slices(column)])
    return steps(split, F.col(response_name))


def explode_rows(df, keep: list, arr: Column, pos: str, val: str):
    """posexplode that evaluates `arr` once.

    A plain (pos)explode makes the optimizer add `size(arr) > 0` as a filter
    and push it below the projections, which evaluates a costly array
    expression twice.  The outer form gets no such filter; empty and null
    arrays give one null row, dropped here."""
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, val))
            .filter(F.col(pos).isNotNull()))
