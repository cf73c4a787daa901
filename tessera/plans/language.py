"""Text preparation over documents as posts and labels as their sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import mapped
from tessera.operators import text as x
from tessera.operators.tables import exact_quantiles, keep_first, settled, small
from tessera.plans.fixtures import table


def posts(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang")


# DuckDB's regular expressions take Unicode classes by name; Spark's do with (?U)
_W = r"\p{L}\p{M}\p{N}"
CLEAN = r"trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+|www\.\S+', '', 'g'), '@[" + _W + r"_]+', '', 'g'), '#', ''), '[^" + _W + r"\s]', ' ', 'g'), '\s+', ' ', 'g'))"
CLEAN_ASCII = r"trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower(text), 'http\S+|www\S+', ' ', 'g'), '@[" + _W + r"_]+', ' ', 'g'), '#', ' '), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS = f"list_filter(string_split_regex({CLEAN}, '\\s+'), lambda t: t <> '')"
RAW = r"list_filter(string_split_regex(trim(lower(text)), '\s+'), lambda t: t <> '')"
STOPS = "[" + ", ".join(f"'{w}'" for w in x.STOP_WORDS) + "]"


def cleaned(s, d):
    return posts(s, d).select("doc_id", x.clean(F.col("text")).alias("clean"))


def cleaned_ascii(s, d):
    return posts(s, d).select("doc_id", x.clean_ascii(F.col("text")).alias("clean"))


def stopped(s, d):
    return posts(s, d).select("doc_id", x.prepared(F.col("text")).alias("prepared"))


def top_words(s, d):
    return x.top_terms(posts(s, d), x.tokens(F.lower("text")), 30)


def vocab(s, d):
    return x.vocabulary(posts(s, d), x.tokens(F.lower("text"))).select("term", F.col("index").cast("bigint").alias("index"))


def padded(s, d):
    words = x.tokens(F.lower("text"))
    seq = x.sequences(posts(s, d), "doc_id", words, x.vocabulary(posts(s, d), words))
    return seq.select("doc_id", F.array_join("ids", " ").alias("ids"))


def lengths(s, d):
    joined = table(s, d, "labels").join(posts(s, d), "doc_id").select("quality", F.length("text").alias("size"))
    counts = joined.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("size"), 6).alias("mean_length"))
    medians = exact_quantiles(joined.where("quality is not null"), [0.5], "quality", "size").select("quality", F.col("q")[0].alias("median_length"))
    return counts.join(small(medians), "quality", "left")


def dedup(s, d):
    return keep_first(posts(s, d), ["text"], ["doc_id"]).select("doc_id", "lang")


def labels(s, d):
    return table(s, d, "labels").select("doc_id", mapped("quality", {0: "Negative", 1: "Positive"}).alias("sentiment"))


EXCEPTIONS = (("was", "be"), ("were", "be"), ("is", "be"), ("are", "be"), ("been", "be"), ("had", "have"), ("has", "have"), ("did", "do"), ("done", "do"), ("thought", "think"))


def lemma_parts(s, d):
    """The distinct words of the cleaned posts, a lexicon of the words that five of them share, and irregular forms; the
    posts are cleaned once for both, and a post's word counts once."""
    each = posts(s, d).select("doc_id", F.explode(F.array_distinct(x.tokens(x.clean_ascii(F.col("text"))))).alias("word"))
    words = settled(each.groupBy("word").agg(F.count_distinct("doc_id").alias("n")))
    return words.select("word"), words.where("n >= 5").select("word"), s.createDataFrame(EXCEPTIONS, "word string, lemma string")


def lemmas(s, d):
    return x.lemma_table(*lemma_parts(s, d))


def lemmatised_posts(s, d):
    """The whole preparation: cleaned, without stop words, lemmas."""
    words = x.without_stop_words(x.tokens(x.clean_ascii(F.col("text"))))
    return x.with_lemmas(posts(s, d), "doc_id", words, x.lemma_table(*lemma_parts(s, d))).select("doc_id", F.array_join("words", " ").alias("prepared"))


def matrix(s, d):
    """The vectors of known terms and of the pad; noise is told by its size alone."""
    words = x.tokens(F.lower("text"))
    v = x.vocabulary(posts(s, d), words, 100)
    vectors = v.where(F.col("index") % 3 == 0).select(F.col("term").alias("word"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.length("term") + i).cast("float")).alias("vector"))
    told = F.when(F.col("found") | (F.col("index") == 0), F.array_join(F.transform("vector", lambda e: e.cast("int")), " "))
    return x.embedding_matrix(v, vectors, 8).select(F.col("index").cast("bigint").alias("index"), "found", told.alias("vector"), F.size("vector").cast("bigint").alias("numbers"), F.exists("vector", lambda e: F.abs(e) > 0.5).alias("large"))


_TERMS = f"(select term, count(*) n from (select unnest({RAW}) term from documents) group by 1)"
_VOCAB = f"(select term, row_number() over (order by n desc, term) + 1 as index from {_TERMS} order by n desc, term limit 9998)"

_ASCII = f"list_filter(string_split_regex({CLEAN_ASCII}, '\\s+'), lambda t: t <> '')"
_ODD = "(values " + ", ".join(f"('{w}', '{m}')" for w, m in EXCEPTIONS) + ") o(word, form)"
_TAKEN = " union all ".join(f"select word, turn + 1, place * 8 + {i}, left(form, len(form) - {len(old)}) || '{new}' from {{t}} where form like '%{old}' and len(form) > {len(old)}" for i, (old, new) in enumerate(x.ENDINGS))
_ONCE, _TWICE, _THRICE = (_TAKEN.format(t=t) for t in ("f0", "f1", "f2"))
LEMMAS = f"""w as (select doc_id, unnest({_ASCII}) word from documents), lexicon as (select word form from w group by 1 having count(distinct doc_id) >= 5), k as (select distinct word from w),
 o as (select * from {_ODD}), f0(word, turn, place, form) as (select word, 0, 0, word from k where word not in (select word from o)), f1(word, turn, place, form) as ({_ONCE}), f2(word, turn, place, form) as ({_TWICE}), f3(word, turn, place, form) as ({_THRICE}),
 c as (select word, 0 turn, -1 place, form from f0 union all select word, 0, place, form from f1 union all select word, turn, place, form from f2 union all select word, turn, place, form from f3
  union all select k.word, 0, 1, o.form from k join o using (word) union all select word, 0, 0, word from k where word in (select word from o)),
 b as (select word, form lemma from c semi join lexicon using (form) qualify row_number() over (partition by word order by turn, len(form), place, form) = 1),
 lemmas as (select word, coalesce(lemma, word) lemma from k left join b using (word))"""

QUERIES = {
    "text_clean": (cleaned, f"select doc_id, {CLEAN} clean from documents"),
    "text_clean_ascii": (cleaned_ascii, f"select doc_id, {CLEAN_ASCII} clean from documents"),
    "text_prepared": (stopped, f"select doc_id, array_to_string(list_filter({TOKENS}, lambda t: not list_contains({STOPS}, t)), ' ') prepared from documents"),
    "token_top_words": (top_words, f"select term, n from {_TERMS} order by n desc, term limit 30"),
    "vocab_index": (vocab, f"select * from {_VOCAB}"),
    "pad_sequences": (padded, f"with v as (select * from {_VOCAB}), w as (select doc_id, unnest({RAW}) term, generate_subscripts({RAW}, 1) p from documents), i as (select doc_id, list(coalesce(v.index, 1) order by p) ids from w left join v using (term) group by 1) select d.doc_id, array_to_string(list_slice(list_concat(coalesce(ids, []), list_transform(range(200), lambda z: 0)), 1, 200), ' ') ids from documents d left join i using (doc_id)"),
    "text_length_by_label": (lengths, "select quality, count(*) n, round(avg(length(text)), 6) mean_length, median(length(text)) median_length from labels join documents using (doc_id) group by 1"),
    "dedup_keep_first": (dedup, "select doc_id, lang from documents qualify row_number() over (partition by text order by doc_id) = 1"),
    "label_decode": (labels, "select doc_id, case quality when 0 then 'Negative' when 1 then 'Positive' end sentiment from labels"),
    "lemma_map": (lemmas, f"with {LEMMAS} select * from lemmas"),
    "text_lemmatised": (lemmatised_posts, f"with {LEMMAS}, t as (select doc_id, unnest(list_filter({_ASCII}, lambda t: not list_contains({STOPS}, t))) word, generate_subscripts(list_filter({_ASCII}, lambda t: not list_contains({STOPS}, t)), 1) p from documents), j as (select doc_id, string_agg(lemma, ' ' order by p) prepared from t join lemmas using (word) group by 1) select doc_id, coalesce(prepared, '') prepared from documents left join j using (doc_id)"),
    "embedding_matrix": (matrix, f"with v as (select * from {_VOCAB} where index < 100) select i as index, coalesce(i % 3 = 0 and i > 1, false) found, case when i = 0 then '0 0 0 0 0 0 0 0' when i % 3 = 0 then array_to_string(list_transform(range(1, 9), lambda k: len(term) + k), ' ') end as vector, 8 numbers, i > 1 and i % 3 = 0 large from range(100) r(i) left join v on v.index = i"),
}
