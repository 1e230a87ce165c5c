"""Fill-in-the-middle: texts cut into prefix, middle and suffix by units, as one ``pyarrow.compute`` pipeline per batch.

1. A byte that UTF-8 never uses is set behind every word, and the batch is split at it into one list
   of units per text (a word with the space before it, or the space at a text's end).
2. The lists are flattened with the index of their parent; a unit's ordinal is its place less the
   first place of its parent.
3. Two draws per text give its two cuts.  Ordinals are held against them, and each role's units are
   filtered out, rebuilt to one list per text and joined to one piece.
4. Pieces and sentinels are joined per row: suffix first (``spm``) or prefix first (``psm``); texts
   that are empty, hold a sentinel or are not drawn stay ``plain``.

Draws are the first four groups of eight hex digits of the SHA-256 of ``seed:key``, so reruns
agree.  A batch is taken in pieces of about a megabyte of text; a longer text stands alone.

Defined results: null counts as empty; an empty text is plain with no unit; a null key is hashed as an
empty string; repeated rows get equal answers; an empty table gives no rows; other columns pass
through (added names replace equal ones).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm import flat

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n_units", "form", "prefix_chars", "middle_chars", "output")
SPLIT = b"\xff"  # in no UTF-8 text
RESULT = "struct<n_units: long, form: string, prefix_chars: long, middle_chars: long, output: string>"


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits for a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substr(digest, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("long") for i in range(4)]


def _modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _chars(pieces: pa.Array) -> pa.Array:
    """Code points: bytes that do not continue a character."""
    return pc.subtract(pc.binary_length(pieces), pc.count_substring_regex(pieces, pattern="[\\x80-\\xBF]")).cast(pa.int64())


def _rebuilt(units: pa.Array, sizes: pa.Array) -> pa.Array:
    """Units joined to one piece per row, given the number of units of each row."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, units), b"")


def transformed_batch(texts: pa.Array, h: list[pa.Array], rate: int, spm_rate: int) -> pa.StructArray:
    """The pipeline over the texts of one batch and their four draws."""
    raw = pc.fill_null(texts, "").cast(pa.binary())
    lists = pc.split_pattern(pc.replace_substring_regex(raw, pattern=rb"[^\x20\x09-\x0D]+", replacement=b"\\0" + SPLIT), pattern=SPLIT)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(units), 0)  # behind a last word stands an empty string
    units, parents = units.filter(real), parents.filter(real)
    rows = pa.array(range(len(raw)), pa.int64())
    held = pc.value_counts(pa.concat_arrays([parents.cast(pa.int64()), rows]))  # each row once more, so that all occur
    n = pc.subtract(held.field("counts").take(pc.sort_indices(held.field("values"))), 1)
    first = pc.subtract(pc.cumulative_sum(n), n)
    ordinal = pc.subtract(pa.array(range(len(units)), pa.int64()), first.take(parents))
    cuts = [_modulo(x, pc.add(n, 1)) for x in h[:2]]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    before, upto = pc.less(ordinal, low.take(parents)), pc.less(ordinal, high.take(parents))
    prefix = _rebuilt(units.filter(before), low)
    middle = _rebuilt(units.filter(pc.and_not(upto, before)), pc.subtract(high, low))
    suffix = _rebuilt(units.filter(pc.invert(upto)), pc.subtract(n, high))
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(h[2], 100), rate))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(raw, pattern=mark))
    spm = pc.less(_modulo(h[3], 100), spm_rate)
    p, s, m = (pa.scalar(x.encode(), pa.binary()) for x in (PREFIX, SUFFIX, MIDDLE))
    join = lambda *parts: pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary()))
    output = pc.if_else(plain, raw, pc.if_else(spm, join(s, suffix, p, prefix, m, middle), join(p, prefix, s, suffix, m, middle)))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    none = pa.scalar(None, pa.int64())
    return pa.StructArray.from_arrays([n, form, pc.if_else(plain, none, _chars(prefix)), pc.if_else(plain, none, _chars(middle)), output.view(pa.string())], list(ADDED))


def restored_batch(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The exact texts again, from output and form alone."""
    raw = outputs.cast(pa.binary())
    moved = pc.fill_null(pc.not_equal(forms, "plain"), False)
    parts = pc.split_pattern_regex(raw.filter(moved), pattern="<[PSM]>")
    spm = pc.equal(forms.filter(moved), "spm")
    one, two, three = (pc.list_element(parts, i) for i in (1, 2, 3))  # nothing stands before the first sentinel
    text = pc.binary_join_element_wise(pc.if_else(spm, two, one), three, pc.if_else(spm, one, two), pa.scalar(b"", pa.binary()))
    return pc.replace_with_mask(raw, moved, text).view(pa.string())


def transformed(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``df`` with ``n_units``, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``; ``rate`` of 100 texts are moved, ``spm_rate`` of 100 of these suffix first."""
    flat.small_batches(df.sparkSession)

    @F.arrow_udf(RESULT)
    def move(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        parts = [transformed_batch(part, [h.slice(at, len(part)) for h in (h1, h2, h3, h4)], rate, spm_rate) for at, part in flat.chunks(texts)]
        return pa.concat_arrays(parts) if parts else transformed_batch(texts, [h1, h2, h3, h4], rate, spm_rate)

    kept = [F.col(f"`{c}`") for c in df.columns if c not in ADDED]
    done = df.select(*kept, move(F.col(text), *draws(F.col(key), seed)).alias("__fim"))
    return done.select(*kept, *[F.col(f"__fim.{c}").alias(c) for c in ADDED])


def restored(output: Column, form: Column) -> Column:
    """The text that ``transformed`` got."""
    @F.arrow_udf("string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return restored_batch(outputs, forms)

    return back(output, form)
