"""Text preparation by built-in expressions: cleaning, tokens, vocabulary, padded sequences, vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import settled, small

# English stop words of the cleaning step, and those that the keeping variant leaves in.
STOP_WORDS = tuple("i me my we our you your he him his she her it its they them their what which who this that these those am is are was were be been being have has had do does did a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very can will just should now".split())
NEGATIONS = ("not", "no", "nor", "n't", "never")


def clean_ascii(c: Column) -> Column:
    """Lower case; addresses, mentions, hash signs, then all but a-z, 0-9 and white space give way to a space, and white
    space is joined."""
    out = F.lower(c)
    for pattern, by in ((r"(?U)http\S+|www\S+", " "), (r"(?U)@\w+", " "), ("#", " "), (r"(?U)[^a-z0-9\s]", " "), (r"(?U)\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def clean(c: Column) -> Column:
    """Lower case; URLs, mentions, hash signs and other signs go; white space is joined. Letters are Unicode's."""
    out = F.lower(c)
    for pattern, by in ((r"(?U)https?://\S+|www\.\S+", ""), (r"(?U)@\w+", ""), ("#", ""), (r"(?U)[^\w\s]|_", " "), (r"(?U)\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda t: t != "")


def without_stop_words(words: Column, keep_negations: bool = False) -> Column:
    stop = [w for w in STOP_WORDS if not (keep_negations and w in NEGATIONS)]
    return F.filter(words, lambda t: ~t.isin(*stop))


def lemmatised(words: Column, lemmas: dict[str, str]) -> Column:
    """Each word's lemma where the map has one, else the word."""
    if not lemmas:
        return words
    table = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


# What a verb's ending may stand for.
ENDINGS = (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""))
#: So many endings one after another are taken off.
ROUNDS = 3


def _detached(form: Column) -> Column:
    made = [F.when(form.endswith(old) & (F.length(form) > len(old)), F.concat(F.substr(form, F.lit(1), F.length(form) - len(old)), F.lit(new))) for old, new in ENDINGS]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def lemma_table(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(word, lemma) of distinct words, by joins: a lexicon (word) of base forms and a table of exceptions (word, lemma).

    A word with an exception has its lemmas and itself as candidates; any other has itself and what is left when an
    ending is taken off, then, only where the lexicon has none of these, what is left when endings are taken off again.
    Of the candidates that the lexicon has, the shortest is the lemma, of equals the first; a word without one is its
    own lemma.
    """
    known = words.select("word").where("word is not null").distinct()
    odd = exceptions.select("word", F.col("lemma").alias("form"))
    listed = odd.select("word").distinct().withColumn("listed", F.lit(True))
    regular = known.join(listed, "word", "left").where("listed is null").select("word")
    rounds = [F.array(F.col("word"))]
    for _ in range(ROUNDS):
        rounds.append(F.flatten(F.transform(rounds[-1], _detached)))
    rounds = [F.concat(rounds[0], rounds[1]), *rounds[2:]]
    tried = regular.select("word", F.posexplode(F.array(*rounds)).alias("turn", "forms")).select("word", "turn", F.posexplode("forms").alias("place", "form"))
    irregular = known.join(odd, "word").select("word", F.lit(0).alias("turn"), F.lit(1).alias("place"), "form")
    itself = known.join(listed, "word", "left_semi").select("word", F.lit(0).alias("turn"), F.lit(0).alias("place"), F.col("word").alias("form"))
    found = tried.unionByName(irregular).unionByName(itself).join(lexicon.select(F.col("word").alias("form")).distinct(), "form", "left_semi")
    best = found.groupBy("word").agg(F.min_by("form", F.struct("turn", F.length("form"), "place", "form")).alias("lemma"))
    return known.join(best, "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))


def with_lemmas(df: DataFrame, key: str, words: Column, lemmas: DataFrame) -> DataFrame:
    """(key, words): each row's words in order, every one as its lemma. The key is unique."""
    long = df.select(F.col(key).alias("key"), F.posexplode_outer(words).alias("place", "word"))
    unlike = settled(lemmas.where("lemma <> word"))  # the other words stay as they are, and need no row
    said = long.join(small(unlike), "word", "left").select("key", "place", F.coalesce("lemma", "word").alias("lemma"))
    listed = said.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("lemma").isNotNull(), F.struct("place", "lemma")))).alias("x"))
    return listed.select(F.col("key").alias(key), F.transform("x", lambda e: e["lemma"]).alias("words"))


def prepared(c: Column, lemmas: dict[str, str] | None = None, keep_negations: bool = False) -> Column:
    """The cleaning pipeline as one text column."""
    return F.array_join(lemmatised(without_stop_words(tokens(clean(c)), keep_negations), lemmas or {}), " ")


def term_counts(df: DataFrame, words: Column) -> DataFrame:
    return df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def top_terms(df: DataFrame, words: Column, k: int) -> DataFrame:
    """The k most frequent terms; ties go in order of the term."""
    return term_counts(df, words).orderBy(F.desc("n"), "term").limit(k)


def vocabulary(df: DataFrame, words: Column, size: int = 10_000) -> DataFrame:
    """(term, index): 1 is for unknown words, terms follow from 2 by falling count. The rank is over `size` rows only."""
    top = top_terms(df, words, size - 2)
    return top.select("term", (F.row_number().over(Window.orderBy(F.desc("n"), "term")) + 1).alias("index"))


def sequences(df: DataFrame, key: str, words: Column, vocab: DataFrame, length: int = 200) -> DataFrame:
    """(key, ids): word ids in order, cut or padded with 0 at the end."""
    long = df.select(key, F.posexplode_outer(F.slice(words, 1, length)).alias("p", "term"))  # what is cut is never joined
    ids = long.join(small(vocab), "term", "left").select(F.col(key).alias("__key"), "p", F.when(F.col("term").isNotNull(), F.coalesce("index", F.lit(1))).alias("__id"))
    lists = ids.groupBy("__key").agg(F.array_sort(F.collect_list(F.when(F.col("__id").isNotNull(), F.struct("p", "__id")))).alias("x"))
    return lists.select(F.col("__key").alias(key), F.slice(F.concat(F.transform("x", lambda e: e["__id"].cast("int")), F.array_repeat(F.lit(0), length)), 1, length).alias("ids"))


def embedding_matrix(vocab: DataFrame, vectors: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(index, vector, found) for the pad (zeros), the unknown word and each term; misses get normal noise of 0.05."""
    # two uniform numbers by hash make a normal one, the same whenever a task runs again
    u = lambda i: (F.shiftrightunsigned(F.xxhash64("index", F.lit(seed), F.lit(i)), 11) + 0.5) / float(1 << 53)
    noise = F.array(*[(F.sqrt(-2 * F.ln(u(2 * i))) * F.cos(2 * math.pi * u(2 * i + 1)) * 0.05).cast("float") for i in range(size)])
    rows = vocab.join(vectors.withColumnRenamed("word", "term"), "term", "left").select("index", F.coalesce("vector", noise).alias("vector"), F.col("vector").isNotNull().alias("found"))
    spark = vocab.sparkSession
    extra = spark.range(2).select(F.col("id").cast("int").alias("index")).select("index", F.when(F.col("index") == 0, F.array_repeat(F.lit(0.0).cast("float"), size)).otherwise(noise).alias("vector"), F.lit(False).alias("found"))
    return rows.unionByName(extra)
