"""One analyser for texts and queries: fold, leave out stop words, strip suffixes.

The same steps run over a column of tokens when an index is built and over the
few words of a query, so both sides meet on the same lexemes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry.functions.stem import stem, stem_word
from ambry.functions.text import tokens

# The stop list of the published Portuguese analyser, its function words
# and the forms of its four auxiliary verbs.
STOP_WORDS = (
    "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando "
    "muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa "
    "num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês vos lhes "
    "meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles "
    "aquelas isto aquilo"
).split()
STOP_VERBS = (
    "estou está estamos estão estive esteve estivemos estiveram estava estávamos estavam estivera estivéramos esteja "
    "estejamos estejam estivesse estivéssemos estivessem estiver estivermos estiverem hei há havemos hão houve "
    "houvemos houveram houvera houvéramos haja hajamos hajam houvesse houvéssemos houvessem houver houvermos "
    "houverem houverei houverá houveremos houverão houveria houveríamos houveriam sou somos são era éramos eram fui "
    "foi fomos foram fora fôramos seja sejamos sejam fosse fôssemos fossem for formos forem serei será seremos serão "
    "seria seríamos seriam tenho tem temos tém tinha tínhamos tinham tive teve tivemos tiveram tivera tivéramos tenha "
    "tenhamos tenham tivesse tivéssemos tivessem tiver tivermos tiverem terei terá teremos terão teria teríamos teriam"
).split()


@dataclass(frozen=True)
class Analyser:
    """``stop`` holds folded words that are not indexed; ``stems`` says whether suffixes go."""

    stop: tuple[str, ...] = ()
    stems: bool = True

    def vocabulary(self, words: DataFrame) -> DataFrame:
        """(word, lexeme) of distinct folded words; stop words are left out."""
        kept = words.where(~F.col("word").isin(list(self.stop))) if self.stop else words
        return stem(kept, "word", "lexeme") if self.stems else kept.select("word", F.col("word").alias("lexeme"))

    def lexemes(self, words: Sequence[str]) -> list[str | None]:
        """What ``vocabulary`` says of a few distinct words, where a task has them at hand; None for stop words."""
        left_out = frozenset(self.stop)
        return [None if w in left_out else stem_word(w) if self.stems else w for w in words]

    def of_texts(self, spark: SparkSession, texts: Sequence[str]) -> list[list[tuple[str, int]]]:
        """(lexeme, place) of the words of a few short texts; a stop word keeps its place empty."""
        if not texts:
            return []
        rows = spark.createDataFrame(list(enumerate(texts)), "at int, text string")
        split = rows.select("at", F.posexplode(tokens(F.col("text"))).alias("place", "word"))
        found = split.join(self.vocabulary(split.select("word").distinct()), "word").select("at", "place", "lexeme")
        out: list[list[tuple[str, int]]] = [[] for _ in texts]
        for row in found.orderBy("at", "place").collect():
            out[row["at"]].append((row["lexeme"], row["place"]))
        return out


#: Accents are folded before the list is asked, as the analyser it stands for does: only the words of
#: the list that have none can match.
PORTUGUESE = Analyser(tuple(w for w in [*STOP_WORDS, *STOP_VERBS] if w.isascii()))
#: Folded words as they are, for texts in other languages.
PLAIN = Analyser((), stems=False)
