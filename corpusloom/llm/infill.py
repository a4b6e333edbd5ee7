"""Fill-in-the-middle: texts cut at line ends, their parts moved by displacement scatter, and the way back by gather."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that are cut at a time, and for which displacements are held at a time.
SLICE, BLOCK = 1 << 23, 1 << 20


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of ``batch`` by about ``most`` bytes of text: the rows, the bytes of their texts and where each begins (and the last ends)."""
    texts = batch.column(column)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield batch.slice(row, to - row), data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def marks_in(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks stand, and in which text."""
    body = data[1:-1]
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & ((body == ord("P")) | (body == ord("S")) | (body == ord("M")))) if len(data) > 2 else np.zeros(0, np.int64)
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + 3 <= starts[text + 1] if len(at) else np.zeros(0, bool)
    return at[inside], text[inside]


def displacements(bounds: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """How far each of ``size`` bytes moves, a block at a time: from ``bounds[i]`` on by ``shifts[i]``.

    A difference array holds the jumps at the bounds, its running sum the shifts; only a block is held.
    """
    jumps, carried = np.diff(shifts, prepend=0), 0
    for low in range(0, size, BLOCK):
        high = min(size, low + BLOCK)
        a, b = np.searchsorted(bounds, [low, high])
        difference = np.zeros(high - low, np.int64)
        np.add.at(difference, bounds[a:b] - low, jumps[a:b])
        difference[0] += carried
        moved = np.cumsum(difference)
        carried = moved[-1]
        yield low, high, moved


def as_strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def cut_and_move(data: np.ndarray, starts: np.ndarray, h: np.ndarray, rate: int, spm: int) -> dict[str, pa.Array]:
    """``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of texts that lie one behind the other."""
    begin, end = starts[:-1], starts[1:]
    breaks = np.flatnonzero(data == 10)
    first, last = np.searchsorted(breaks, begin), np.searchsorted(breaks, end)
    closed = last - first
    open_end = (end > begin) & ((data[np.maximum(end - 1, 0)] if len(data) else end) != 10)
    n = closed + open_end
    ends = np.append(breaks + 1, 0)  # of the lines that are closed

    def after(lines: np.ndarray) -> np.ndarray:
        return np.where(lines == 0, begin, np.where(lines <= closed, ends[np.minimum(first + lines - 1, len(ends) - 1)], end))

    a, b = after(np.minimum(h[0] % (n + 1), h[1] % (n + 1))), after(np.maximum(h[0] % (n + 1), h[1] % (n + 1)))
    marked = np.bincount(marks_in(data, starts)[1], minlength=len(n)) > 0
    plain, suffix_first = (end == begin) | marked | (h[2] % 100 >= rate), h[3] % 100 < spm
    a, b = np.where(plain, end, a), np.where(plain, end, b)  # a plain text is all prefix
    prefix, suffix = a - begin, end - b
    out_starts = starts + 9 * np.concatenate([[0], np.cumsum(~plain)])
    at, wide = out_starts[:-1], np.where(plain, 0, 3)
    to_prefix = at + wide + np.where(suffix_first & ~plain, suffix + 3, 0)
    to_suffix = at + wide + np.where(suffix_first, 0, prefix + 3)
    to_middle = at + 3 * wide + prefix + suffix
    bounds = np.stack([begin, a, b], axis=1).ravel()
    shifts = np.stack([to_prefix, to_middle, to_suffix], axis=1).ravel() - bounds
    out = np.empty(out_starts[-1], np.uint8)
    for low, high, moved in displacements(bounds, shifts, len(data)):
        out[np.arange(low, high) + moved] = data[low:high]
    for mark, places in zip(MARKS, (to_prefix, to_suffix, to_middle), strict=True):
        out[places[~plain, None] + np.arange(-3, 0)] = np.frombuffer(mark.encode(), np.uint8)
    inner = np.flatnonzero(data & 0xC0 == 0x80)  # bytes that begin no code point
    chars = lambda x, y: y - x - (np.searchsorted(inner, y) - np.searchsorted(inner, x))
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    return {"n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(chars(begin, a), pa.int64(), mask=plain), "middle_chars": pa.array(chars(a, b), pa.int64(), mask=plain), "output": as_strings(out, out_starts)}


def move_back(data: np.ndarray, starts: np.ndarray, form: np.ndarray) -> pa.Array:
    """The texts, from outputs that lie one behind the other and their forms."""
    at, text = marks_in(data, starts)
    cut = form != "plain"
    at = at[cut[text]].reshape(-1, 3)  # three marks in each text that was cut
    begin, end = starts[:-1], starts[1:]
    first, second, middle = (begin.copy() for _ in range(3))  # where the parts begin
    first[cut], second[cut], middle[cut] = at[:, 0] + 3, at[:, 1] + 3, at[:, 2] + 3
    one, two, three = np.where(cut, second - 3 - first, end - begin), np.where(cut, middle - 3 - second, 0), np.where(cut, end - middle, 0)
    spm = form == "spm"
    prefix, prefix_at = np.where(spm, two, one), np.where(spm, second, first)
    suffix_at = np.where(spm, first, second)
    out_starts = starts - 9 * np.concatenate([[0], np.cumsum(cut)])
    bounds = np.stack([out_starts[:-1], out_starts[:-1] + prefix, out_starts[:-1] + prefix + three], axis=1).ravel()
    shifts = np.stack([prefix_at, middle, suffix_at], axis=1).ravel() - bounds
    out = np.empty(out_starts[-1], np.uint8)
    for low, high, moved in displacements(bounds, shifts, len(out)):
        out[low:high] = data[np.arange(low, high) + moved]
    return as_strings(out, out_starts)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and the ``output``.

    A text is cut after two of its lines, chosen by the SHA-256 of seed and id; ``rate`` per cent of the
    texts are cut, of which ``spm`` per cent with the suffix first. Empty texts and texts that hold a mark
    stay plain. A null text counts as empty, a null id as the empty text in the hash; rows that repeat an
    id are cut each by itself; an empty table gives an empty result; other columns are ignored.

    Texts are moved where they are read, without a shuffle: a long text costs its own size for the
    output, and displacements of ``BLOCK`` bytes at a time.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("h"))
    rows = rows.select("doc_id", "text", *(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in text_slices(batch, 1):
                made = cut_and_move(data, starts, np.stack([part.column(k).to_numpy() for k in range(2, 6)]), rate, spm)
                yield pa.RecordBatch.from_arrays([part.column(0), *made.values()], names=["doc_id", *made])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` returned, with the text ``restored`` from ``output`` and ``form`` alone."""
    names = outputs.columns
    at, form = names.index("output"), names.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in text_slices(batch, at):
                back = move_back(data, starts, np.array(part.column(form).to_pylist(), object))
                yield pa.RecordBatch.from_arrays([*part.columns, back], names=[*names, "restored"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in outputs.dtypes)
    return outputs.mapInArrow(run, f"{schema}, restored string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM l),
p AS (SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:n], ''), '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
