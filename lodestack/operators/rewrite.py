"""Rewriting of references inside texts: every known name wherever it stands, the longest first, by Aho-Corasick automata over a package's names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodestack.shared import written

#: Characters of names that one automaton holds (some 40 to 100 bytes of memory each); a package of more has several.
KEY_CHARS = 1 << 20

#: Characters of text that one task is to read; a package of more is dealt to several, each with the names.
TEXT_CHARS = 64 << 20

_HIT = StructType([StructField("at", IntegerType()), StructField("size", IntegerType()), StructField("new", StringType())])


def spellings(mapping: DataFrame) -> DataFrame:
    """``mapping`` (package, old, new) with the other spellings of ``old`` that texts have: links with one slash after the scheme, and slashes that JSON
    escapes (``new`` is then escaped as well). What a mapping spells out itself goes first; of several ``new`` the smallest counts; empty names go."""
    rows = mapping.where((F.col("old") != "") & F.col("new").isNotNull())
    escaped = lambda c: F.replace(c, F.lit("/"), F.lit("\\/"))
    slash = rows.where(F.rlike("old", F.lit("^https?://"))).withColumn("old", F.regexp_replace("old", "^(https?):/", "$1:"))
    plain = rows.withColumn("rank", F.lit(0)).unionByName(slash.withColumn("rank", F.lit(1)))
    json = plain.where(F.contains("old", F.lit("/"))).withColumns({"old": escaped("old"), "new": escaped("new"), "rank": F.col("rank") + 2})
    return plain.unionByName(json).groupBy("package", "old").agg(F.min(F.struct("rank", "new")).alias("v")).select("package", "old", F.col("v.new").alias("new"))


def replaced(text: str, hits: Iterable[tuple[int, int, str]]) -> str:
    """``text`` with its hits (start, length, new) put in: from the left, of one start the longest, none that begins in another."""
    out, at = [], 0
    for start, size, new in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start >= at:
            out += (text[at:start], new)
            at = start + size
    out.append(text[at:])
    return "".join(out)


def _longest(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    """For each place where a name stands the longest that does."""
    found: dict[int, tuple[int, str]] = {}
    for end, (size, new) in automaton.iter(text):
        start = end - size + 1
        if start not in found or found[start][0] < size:
            found[start] = (size, new)
    return [(start, size, new) for start, (size, new) in found.items()]


def _matched(stream: DataFrame, whole: bool) -> DataFrame:
    """The files of ``stream`` with their text rewritten (``whole``), or with ``hits``. A partition has of each (package, block, share) first the names
    (kind 0), then the files (kind 1): it builds one automaton at a time and streams the texts past it."""
    keep = [c for c in stream.columns if c not in ("package", "block", "share", "kind", "old", "new")]
    fields = [f for f in stream.schema.fields if f.name in keep]

    def matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, automaton, ready = None, None, False
        for batch in batches:
            files, out = [], []
            columns = [batch.column(c).to_pylist() for c in ("package", "block", "share", "kind", "old", "new", "text")]
            for row, (package, block, share, kind, old, new, text) in enumerate(zip(*columns)):
                if (package, block, share) != own:
                    own, automaton, ready = (package, block, share), ahocorasick.Automaton(), False
                if kind == 0:
                    automaton.add_word(old, (len(old), new))
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                hits = _longest(automaton, text)
                files.append(row)
                out.append(replaced(text, hits) if whole else [{"at": a, "size": n, "new": v} for a, n, v in hits])
            piece = batch.select(keep).take(pa.array(files, pa.int64()))
            if whole:
                piece = piece.set_column(keep.index("text"), "text", pa.array(out, pa.string()))
                yield piece
            else:
                kind = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("new", pa.string())]))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, kind)], [*keep, "hits"])

    return stream.mapInArrow(matched, StructType(fields if whole else [*fields, StructField("hits", ArrayType(_HIT))]))


def _stream(files: DataFrame, keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """Names and files of packages together, dealt by (package, block, share): blocks divide a package's names, shares its files."""
    share = lambda n: F.pmod(F.xxhash64("row", "text"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    names = keys.join(sizes, "package").select("package", F.pmod(F.xxhash64("old"), "blocks").alias("block"), F.explode(upto("shares")).alias("share"), F.lit(0).alias("kind"), "old", "new")
    texts = files.join(sizes, "package").select("package", F.explode(upto("blocks")).alias("block"), share(F.col("shares")).alias("share"), F.lit(1).alias("kind"), "row", "text")
    both = names.unionByName(texts, allowMissingColumns=True)
    return both.repartition("package", "block", "share").sortWithinPartitions("package", "block", "share", "kind")


def rewrite_refs(files: DataFrame, mapping: DataFrame, *, package: str | None = None, key_chars: int = KEY_CHARS, text_chars: int = TEXT_CHARS) -> DataFrame:
    """``files`` (path, text, ...) with every name that ``mapping`` (old, new) knows replaced wherever it stands in a text, also inside longer ones.

    Matches are taken from the left, of those at one place the longest; what comes in isn't looked at again. Links are also found with one slash after the
    scheme, and all names with slashes escaped as in JSON. With ``package``, a column of both tables, a file's names are those of its package.

    Each package's names make an automaton, past which tasks stream its files; a package of more than ``key_chars`` characters of names has several, and one
    of more than ``text_chars`` of text several tasks, so neither a hot package nor one of a million names is one task's or more than its memory. Null texts
    become empty; a null package is a package; files without names stay as they are. Repeated rows are rewritten each.
    """
    own = lambda df: F.coalesce(F.concat(F.lit("="), F.col(package).cast("string")), F.lit("")) if package else F.lit("")
    keys = written(spellings(mapping.select(own(mapping).alias("package"), "old", "new")))
    rows = files.select(own(files).alias("package"), F.struct(*[F.col(f"`{c}`") for c in files.columns if c != "text"]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    parts = lambda c, n: F.greatest(F.ceil(F.col(c) / n), F.lit(1)).cast("int")
    names = keys.groupBy("package").agg(F.sum(F.length("old")).alias("key_chars"))
    sizes = rows.groupBy("package").agg(F.sum(F.length("text")).alias("text_chars")).join(names, "package")
    sizes = written(sizes.select("package", parts("key_chars", key_chars).alias("blocks"), parts("text_chars", text_chars).alias("shares")))
    small, large = sizes.where("blocks = 1"), sizes.where("blocks > 1")
    done = _matched(_stream(rows, keys, small), True).unionByName(rows.join(sizes, "package", "left_anti").select("row", "text"))
    if large.limit(1).count():
        many = written(rows.join(large.select("package"), "package", "left_semi").withColumn("id", F.monotonically_increasing_id()))
        dealt = many.select("package", F.struct("id").alias("row"), "text")
        hits = _matched(_stream(dealt, keys, large), False).where(F.size("hits") > 0).groupBy("row.id").agg(F.flatten(F.collect_list("hits")).alias("hits"))
        done = done.unionByName(_assembled(many.join(hits, "id", "left").select("row", "text", "hits")))
    return done.select(*[F.col("text") if c == "text" else _field(c) for c in files.columns])


def _field(name: str) -> Column:
    return F.col("row").getField(name).alias(name)


def _assembled(files: DataFrame) -> DataFrame:
    def assembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist())
            text = [replaced(t, [(h["at"], h["size"], h["new"]) for h in hits or ()]) for t, hits in rows]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], ["row", "text"])

    return files.mapInArrow(assembled, StructType([files.schema["row"], files.schema["text"]]))
