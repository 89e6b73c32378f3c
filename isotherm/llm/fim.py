"""Fill-in-the-middle over ropes.

A text becomes a rope (see ``rope``), which is split at two unit ranks; prefix, middle and
suffix are joined again in another order, with sentinels as leaves between them:

    psm  <P>prefix<S>suffix<M>middle        spm  <S>suffix<P>prefix<M>middle

Ranks and form come from a hash of the document's id alone, so runs agree.  The
inverse reads output and form only: a text that holds a sentinel stays plain, so the
first of each sentinel is the template's (a sentinel starts with ``<``, ends with ``>`` and
has neither inside, so none can arise across a seam); the output's rope is split there.

Null texts count as empty; empty texts, and texts with a sentinel, stay plain.  A null id
hashes as no digits.  Rows that repeat an id are cut by the same hash, each by its own
length.  A text of any length is one row and is handled whole; its work is linear.
Extra columns are ignored.  No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.rope import Rope, Units, join, text_of
from isotherm.llm.store import small_batches

#: fixed values: the sentinels
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: parts of a hundred: documents left plain, and of the others those with the suffix first
PLAIN, SPM = 10, 20
SALT = "1"


def arrange(units: Units, rope: Rope, low: int, high: int, form: str) -> tuple[Rope, Rope, Rope]:
    """The output's rope, and those of prefix and middle."""
    prefix, rest = units.split(rope, low)
    middle, suffix = units.split(rest, high - low)
    p, s, m = (units.leaf(x) for x in (PREFIX, SUFFIX, MIDDLE))
    parts = (p, prefix, s, suffix) if form == "psm" else (s, suffix, p, prefix)
    return join(*parts, m, middle), prefix, middle


def invert(units: Units, output: str, form: str) -> str:
    """The text that ``arrange`` was given."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a = output.index(first) + len(first)
    b = output.index(second, a)
    c = output.index(MIDDLE, b + len(second))
    body, middle = units.split(units.build(output), c + len(MIDDLE), "chars")
    body, two = units.split(body, b + len(second), "chars")
    _, one = units.split(units.split(body, b, "chars")[0], a, "chars")
    two = units.split(two, c - b - len(second), "chars")[0]
    return text_of(join(one, middle, two) if form == "psm" else join(two, middle, one))


FORMATTED = "id string, n long, chars long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]
_NAMES = [x.split()[0] for x in FORMATTED.split(", ")]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | None = None, plain: int = PLAIN, spm: int = SPM, salt: str = SALT) -> DataFrame:
    """``id, n, chars, form, prefix_units, middle_units, prefix_chars, middle_chars, output`` for every row.

    ``unit``: a pattern of where units start, else code points; ``n`` counts units.  Of a hundred documents ``plain`` stay as
    they are, of the others ``spm`` have the suffix first.  Sizes of plain rows are null.
    """
    small_batches(docs.sparkSession)
    units = Units(unit)
    digest = F.sha2(F.encode(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), "UTF-8"), 256)
    number = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    sentinel = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    hashed = rows.select("id", "text", sentinel.alias("sentinel"), *[number(k) for k in range(4)])
    form = F.when((F.col("text") == "") | F.col("sentinel") | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    kind = dict(rows.dtypes)["id"]
    fields = FORMATTED.replace("id string", f"id {kind}", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, h1, h2, form in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                text, form = text.as_py(), form.as_py()
                rope = units.build(text)
                if form == "plain":
                    out.append((rope.units, rope.chars, form, None, None, None, None, text))
                    continue
                low, high = sorted(h.as_py() % (rope.units + 1) for h in (h1, h2))
                made, prefix, middle = arrange(units, rope, low, high, form)
                out.append((rope.units, rope.chars, form, low, high - low, prefix.chars, middle.chars, text_of(made)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES[1:], strict=True))], names=_NAMES) if out else pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([], t) for t in _TYPES[1:])], names=_NAMES)

    return hashed.select("id", "text", "h1", "h2", form.alias("form")).mapInArrow(run, fields)


def restore(formatted: DataFrame, unit: str | None = None) -> DataFrame:
    """``formatted`` with ``restored``: the text rebuilt from ``output`` and ``form``."""
    units = Units(unit)
    names = [*formatted.columns, "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [invert(units, o.as_py(), f.as_py()) for o, f in zip(batch.column("output"), batch.column("form"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return formatted.mapInArrow(run, formatted.withColumn("restored", F.lit("")).schema)


def fim_digests(docs: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    back = restore(fill_in_middle(docs))
    return back.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))
