"""Finding and reading references to catalogued works: 'Third Book 3.5-7'.

The catalogue is a table of spellings. A title offers every stretch of it that
begins and ends with a word, and the two meet in an equality join, so neither
the plan nor the driver grows with the catalogue. What follows a mention is
read token by token by a small state machine.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry.functions.text import fold_squeeze

# Words that number a work, the nouns they go with, and what may follow the noun.
ORDINALS = {"primeira": "1", "primeiro": "1", "segunda": "2", "segundo": "2", "terceira": "3", "terceiro": "3"}
NOUNS = ["carta", "epistola", "livro"]
JOINERS = ["de", "dos", "do", "da"]
ROMANS = {"i": "1", "ii": "2", "iii": "3"}
DASHES = ["-", "\u2013", "\u2014"]
LIST_SEPARATOR = "|"
_SCHEMA = "position int, slug string, name string, chapters int, abbrevs array<string>, aliases array<string>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def with_numerals(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the folded text, with numbers for what counts a work in words.

    'Primeira carta de' and 'I' both become '1'. Works on words, each of which
    looks at its neighbours.
    """
    plain = fold_squeeze(F.translate(F.coalesce(F.col(text), F.lit("")), "\u00ba\u00aa\u00b0", "   "))
    df = df.withColumn("_plain", plain).withColumn("_w", F.split("_plain", " "))

    def told(at: Column) -> Column:
        return _lookup(ORDINALS, F.get("_w", at)).isNotNull() & F.get("_w", at + 1).isin(NOUNS)

    def read(word: Column, i: Column) -> Column:
        counted = F.coalesce(told(i), F.lit(False))
        noun = F.coalesce(told(i - 1), F.lit(False))
        joiner = F.coalesce(told(i - 2) & word.isin(JOINERS), F.lit(False))
        roman = F.when(i < F.size("_w") - 1, _lookup(ROMANS, word))
        return F.when(counted, _lookup(ORDINALS, word)).when(~noun & ~joiner, F.coalesce(roman, word))

    # most texts count nothing in words and need no second look
    counts = rf"\b(?:{'|'.join([*ORDINALS, *ROMANS])})\b"
    return df.withColumn(out, F.when(F.col("_plain").rlike(counts), F.array_join(F.transform("_w", read), " ")).otherwise(
        F.col("_plain"))).drop("_w", "_plain")


def _pieces(col: Column) -> Column:
    """Runs of letters, runs of digits, and every other character by itself."""
    return F.regexp_extract_all(col, F.lit("[a-z]+|[0-9]+|[^a-z0-9]"), F.lit(0))


def _is_word(piece: Column) -> Column:
    return piece.rlike("^[a-z0-9]")


@dataclass(frozen=True)
class Work:
    position: int
    slug: str
    name: str
    chapters: int
    abbreviations: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()


class Catalogue:
    """Works as a table; ``spellings`` is what titles are joined with."""

    def __init__(self, works: Iterable[Work] | DataFrame):
        self._works = works if isinstance(works, DataFrame) else list(works)

    @classmethod
    def read(cls, table: DataFrame) -> Catalogue:
        """From (position, slug, name, chapters, abbrevs, aliases), lists separated by bars."""
        def split(name: str) -> Column:
            parts = F.split(F.coalesce(F.col(name), F.lit("")), f"[{LIST_SEPARATOR}]")
            return F.filter(F.transform(parts, lambda v: F.trim(v)), lambda v: v != "").alias(name)

        return cls(table.select(
            F.col("position").cast("int"), F.trim("slug").alias("slug"), F.trim("name").alias("name"),
            F.col("chapters").cast("int"), split("abbrevs"), split("aliases"),
        ))

    def works(self, spark: SparkSession) -> DataFrame:
        if isinstance(self._works, DataFrame):
            return self._works
        return spark.createDataFrame([tuple(map(_plain, astuple(w))) for w in self._works], _SCHEMA)

    def spellings(self, spark: SparkSession) -> DataFrame:
        """(spelling, tier, slug, chapters, n_pieces): names are tier 0; abbreviations, tier 1, need a number after them.

        A spelling that several works share belongs to the first of them.
        """
        works = self.works(spark)
        names = F.transform(F.concat(F.array("name"), "aliases"), lambda v: F.struct(F.lit(0).alias("tier"), v.alias("raw")))
        short = F.transform("abbrevs", lambda v: F.struct(F.lit(1).alias("tier"), v.alias("raw")))
        # '1Co' is also written '1 Co'
        apart = F.transform(
            F.filter("abbrevs", lambda v: v.rlike("^[123]")),
            lambda v: F.struct(F.lit(1).alias("tier"), F.concat_ws(" ", F.left(v, F.lit(1)), F.ltrim(F.substr(v, F.lit(2)))).alias("raw")),
        )
        rows = works.select("position", "slug", "chapters", F.explode(F.concat(names, short, apart)).alias("s"))
        read = with_numerals(rows.select("position", "slug", "chapters", "s.tier", "s.raw"), "raw", "spelling")
        least = F.min(F.struct("position", "slug", "chapters")).alias("w")
        return read.where(F.col("spelling").rlike("[a-z0-9]")).groupBy("spelling", "tier").agg(least).select(
            "spelling", "tier", "w.slug", "w.chapters", F.size(_pieces(F.col("spelling"))).alias("n_pieces")
        )


def _plain(value):
    return list(value) if isinstance(value, tuple) else value


def mentions(texts: DataFrame, catalogue: Catalogue) -> DataFrame:
    """(text, work, limit, rest) of the distinct ``texts`` (text) that mention a work.

    The earliest mention counts; at one place a name beats an abbreviation and
    a longer spelling a shorter one. ``rest`` is the folded text after it and
    ``limit`` the work's number of chapters.
    """
    spellings = catalogue.spellings(texts.sparkSession).withColumn("begins", F.get(_pieces(F.col("spelling")), F.lit(0)))
    # how long the spellings are that begin with a word: only there is a stretch of a text looked at
    openings = spellings.groupBy("begins").agg(F.collect_set("n_pieces").alias("sizes"))
    read = with_numerals(texts.distinct(), "text", "hay").withColumn("p", _pieces(F.col("hay")))
    begins = F.filter(
        F.transform("p", lambda x, i: F.struct(i.alias("at"), x.alias("piece"))),
        lambda s: _is_word(s["piece"]) & ~F.coalesce(_is_word(F.get("p", s["at"] - 1)), F.lit(False)),
    )
    # outer, since a test for emptiness would be pushed below the distinct and take every row apart
    starts = read.select("text", "p", F.explode_outer(begins).alias("s")).select("text", "p", "s.at", "s.piece")
    known = starts.join(openings, F.col("piece") == F.col("begins"))
    widths = F.filter("sizes", lambda n: F.col("at") + n <= F.size("p"))
    stretches = known.select("text", "p", "at", F.explode(widths).alias("n")).select(
        "text", "p", "at", "n", F.array_join(F.slice("p", F.col("at") + 1, F.col("n")), "").alias("spelling")
    )
    behind = F.col("at") + F.col("n")
    rest = F.array_join(F.slice("p", behind + 1, F.size("p")), "")
    hits = stretches.join(spellings.drop("begins"), "spelling").select(
        "text", "at", "tier", "spelling", "slug", "chapters", rest.alias("rest"),
        F.coalesce(_is_word(F.get("p", behind)), F.lit(False)).alias("goes_on"),
    ).where(F.when(F.col("tier") == 0, ~F.col("goes_on")).otherwise(F.ltrim("rest").rlike("^[0-9]")))
    first = F.min_by(F.struct("slug", "chapters", "rest"), F.struct("at", "tier", -F.length("spelling"))).alias("m")
    return hits.groupBy("text").agg(first).select(
        "text", F.col("m.slug").alias("work"), F.col("m.chapters").alias("limit"), F.col("m.rest").alias("rest")
    )


def find_work(
    df: DataFrame, text: str, catalogue: Catalogue, prefix: str = "ref_", found: DataFrame | None = None
) -> DataFrame:
    """Adds the earliest mention of a work: ``{prefix}work``, ``{prefix}limit`` and ``{prefix}rest``.

    ``found`` are the ``mentions`` of these and perhaps other texts, where they are known already.
    """
    if found is None:
        found = mentions(df.select(F.col(text).alias("text")), catalogue)
    return _with_found(df, text, found, prefix)


def _with_found(df: DataFrame, text: str, found: DataFrame, prefix: str) -> DataFrame:
    """Adds the columns of ``found``, prefixed, which has at most one row for a text."""
    renamed = found.select(*[F.col(c).alias("_text" if c == "text" else f"{prefix}{c}") for c in found.columns])
    return df.join(renamed, F.col(text) == F.col("_text"), "left").drop("_text")


# What a token does in each state; a token without an entry ends the reading. Tokens are
# n(umber of up to three digits), p(oint or colon), d(ash), c(omma or 'e') and l(etter).
# A state is named after the number that was read last, or with > after what is awaited.
_MOVES = {
    "start n": "chapter", "chapter p": ">verse", "chapter l": "chapter-", "chapter d": ">to", "chapter c": ">more",
    "chapter- d": ">to", "chapter- c": ">more", ">verse n": "verse", "verse l": "verse-", "verse d": ">to",
    "verse c": ">more", "verse- d": ">to", "verse- c": ">more", ">to n": "to", "to p": ">to_verse", "to l": "to-",
    "to c": ">more", "to- c": ">more", ">to_verse n": "to_verse", "to_verse l": "to_verse-", "to_verse c": ">more",
    "to_verse- c": ">more", ">more n": "more", "more l": "more-", "more c": ">more", "more- c": ">more",
}


def _token_kind(t: Column) -> Column:
    return (
        F.when(t.rlike("^[0-9]"), F.when(F.length(t) <= 3, "n"))
        .when(t.isin(".", ":"), "p").when(t.isin(DASHES), "d").when(t.isin(",", "e"), "c")
        .when(t.rlike("^[a-z]$"), "l")
    )


def _numbers(rest: Column) -> Column:
    """[(state, number), ...] read from the start of ``rest``, in order."""
    tokens = F.filter(_pieces(rest), lambda t: F.trim(t) != "")
    none = F.array().cast("array<struct<state:string,number:int>>")

    def step(s: Column, t: Column) -> Column:
        after = F.coalesce(_lookup(_MOVES, F.concat_ws(" ", s["state"], _token_kind(t))), F.lit("end"))
        read = F.when(
            t.rlike("^[0-9]") & (after != "end"),
            F.concat(s["found"], F.array(F.struct(after.alias("state"), t.try_cast("int").alias("number")))),
        ).otherwise(s["found"])
        return F.struct(after.alias("state"), read.alias("found"))

    return F.aggregate(tokens, F.struct(F.lit("start").alias("state"), none.alias("found")), step, lambda s: s["found"])


def readings(found: DataFrame) -> DataFrame:
    """(text, work, chapter_start, chapter_end, verse_start, verse_end) of ``mentions``, one row per text.

    A chapter outside its work leaves the work alone; a chapter range running
    backwards or beyond the work shrinks to its first chapter; numbers listed
    after a comma or 'e' extend the verses.
    """
    # a generated column is made once; a projected one would be copied into each of its uses
    rows = found.select("text", "work", "limit", F.explode(F.array(_numbers(F.col("rest")))).alias("read"))

    def said(state: str, place: int = 0) -> Column:
        mine = F.transform(F.filter("read", lambda r: r["state"] == state), lambda r: r["number"])
        return F.try_element_at(mine, F.lit(-1)) if place < 0 else F.get(mine, F.lit(place))

    numbers = {s: said(s) for s in ("chapter", "verse", "to", "to_verse")} | {"more": said("more"), "last_more": said("more", -1)}
    told = F.explode(F.array(F.struct(*[c.alias(n) for n, c in numbers.items()]))).alias("n")
    rows = rows.select("text", "work", "limit", told).select("text", "work", "limit", "n.*")
    chapter, verse, to, to_verse, limit = (F.col(n) for n in ("chapter", "verse", "to", "to_verse", "limit"))
    inside = chapter.between(1, limit)
    # the number after a dash is a chapter if it has a verse of its own, or if nothing before it has
    end = F.when(to.isNotNull() & (to_verse.isNotNull() | verse.isNull()), to).otherwise(chapter)
    last = F.coalesce(to_verse, F.when(verse.isNotNull(), F.coalesce(to, verse)))
    return rows.select(
        "text", "work", F.when(inside, chapter).alias("chapter_start"),
        F.when(inside, F.when((end < chapter) | (end > limit), chapter).otherwise(end)).alias("chapter_end"),
        F.when(inside, F.coalesce(verse, "more")).alias("verse_start"),
        F.when(inside, F.coalesce("last_more", last)).alias("verse_end"),
    )


def parse_reference(
    df: DataFrame, text: str, catalogue: Catalogue, prefix: str = "ref_", found: DataFrame | None = None
) -> DataFrame:
    """Adds work, chapter_start, chapter_end, verse_start and verse_end, prefixed, by the rules of ``readings``.

    A text is read once, however many rows bear it.
    """
    if found is None:
        found = mentions(df.select(F.col(text).alias("text")), catalogue)
    return _with_found(df, text, readings(found), prefix)


def expand_chapters(refs: DataFrame) -> DataFrame:
    """One row per chapter of a range; verses belong to its first and last chapter.

    Works named without a chapter become chapter 0.
    """
    start = F.col("chapter_start")
    last = F.when(F.col("chapter_end") > start, F.col("chapter_end")).otherwise(start)
    numbers = F.when(start.isNull(), F.array(F.lit(0))).otherwise(F.sequence(start, last))
    others = [c for c in refs.columns if c not in ("chapter_start", "chapter_end", "verse_start", "verse_end")]
    rows = refs.withColumn("chapter", F.explode(numbers))
    at = F.col("chapter")
    return rows.select(
        *others, "chapter",
        F.when(at == start, F.col("verse_start")).alias("verse_start"),
        F.when(at == F.col("chapter_end"), F.col("verse_end")).alias("verse_end"),
    )


def decision_rows(decisions: DataFrame, works: DataFrame) -> DataFrame:
    """Reference rows from a labeller's answers (doc_id, name, chapter and verse bounds).

    Unknown works and chapters outside their work are rejected; the end is
    clamped to the work.
    """
    known = works.select("name", F.col("slug").alias("work"), "chapters")
    start = F.col("chapter_start")
    valid = decisions.join(known, "name").where(start.isNull() | start.between(1, F.col("chapters")))
    end = F.least(F.coalesce("chapter_end", "chapter_start"), F.col("chapters"))
    return expand_chapters(valid.withColumn("chapter_end", end).select(
        "doc_id", "work", "chapter_start", "chapter_end", "verse_start", "verse_end"
    ))
