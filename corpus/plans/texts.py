"""Queries on texts: functions, features, the level lexicon, region markers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import table
from ..functions import features as f
from ..functions import text as t

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(g):
        QUERIES[name] = g
        if sql:
            SQL[name] = sql
        return g

    return put


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_WORD = "[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*"
SENTS = f"""WITH s0 AS (SELECT rec_id, regexp_extract_all(lower(generated_text), '[^.!?\n]+') AS ss FROM generated_corpus WHERE length(generated_text) >= 10),
s1 AS (SELECT rec_id, list_filter(list_transform(ss, lambda s: regexp_extract_all(s, '{_WORD}')), lambda w: len(w) > 0) AS sents FROM s0),
docs AS (SELECT rec_id, sents, flatten(sents) AS words, len(sents) AS k, len(flatten(sents)) AS n FROM s1 WHERE len(sents) > 0)"""
SENTS = SENTS.replace("\\p{N}", "\\p{N}")


def generated(spark, sf):
    return table(spark, sf, "generated_corpus")


def feature_query(name: str, column: str, sql: str):
    @query(name, f"{SENTS}{sql}")
    def one(spark, sf):
        return f.with_features(generated(spark, sf), "rec_id", "generated_text", [column]).select("rec_id", F.round(column, 6).alias(column))

    one.__doc__ = f"{column} of each generated text."


@query("feat_all")
def all_features(spark, sf):
    """All features of each generated text in one pass."""
    return f.with_features(generated(spark, sf), "rec_id", "generated_text")


def _share(cond: str, column: str) -> str:
    return f" SELECT rec_id, round(100.0 * len(list_filter(words, lambda w: {cond})) / n, 6) AS {column} FROM docs"


feature_query("feat_f01_word_count", "word_count", " SELECT rec_id, CAST(n AS DOUBLE) AS word_count FROM docs")
feature_query("feat_f02_sentence_length", "sentence_length", " SELECT rec_id, round(n / k, 6) AS sentence_length FROM docs")
_PASS = ", {state} AS (SELECT rec_id, list_reduce({words}, lambda a, x: CASE WHEN len(list_distinct(list_append(a.u, x.u[1]))) <= 0.72 * (a.n + 1) THEN {{'f': a.f + 1.0, 'n': 0, 'u': CAST([] AS VARCHAR[])}} ELSE {{'f': a.f, 'n': a.n + 1, 'u': list_distinct(list_append(a.u, x.u[1]))}} END, {{'f': CAST(0 AS DOUBLE), 'n': 0, 'u': CAST([] AS VARCHAR[])}}) AS s FROM wrapped)"
_WRAP = ", wrapped AS (SELECT rec_id, n, list_transform(words, lambda w: {'f': CAST(0 AS DOUBLE), 'n': 0, 'u': [w]}) AS items FROM docs)"
feature_query("feat_f05_mtld", "mtld", _WRAP + _PASS.format(state="there", words="items") + _PASS.format(state="back", words="list_reverse(items)") + """
, fs AS (SELECT rec_id, d.n, a.s.f + CASE WHEN a.s.n > 0 THEN (1 - len(a.s.u) / a.s.n) / (1 - 0.72) ELSE 0 END AS x, b.s.f + CASE WHEN b.s.n > 0 THEN (1 - len(b.s.u) / b.s.n) / (1 - 0.72) ELSE 0 END AS y FROM there a JOIN back b USING (rec_id) JOIN docs d USING (rec_id))
SELECT rec_id, round(CASE WHEN x = 0 OR y = 0 THEN 0 ELSE n / ((x + y) / 2) END, 6) AS mtld FROM fs""")
_FREQ = ", freq AS (SELECT rec_id, any_value(n) AS n, w, count(*) AS c FROM (SELECT rec_id, n, unnest(words) AS w FROM docs) GROUP BY rec_id, w)"
feature_query("feat_f06_top20_word_share", "top20_word_share", _FREQ + " SELECT rec_id, round(100.0 * list_sum(list(c ORDER BY c DESC)[1:20]) / any_value(n), 6) AS top20_word_share FROM freq GROUP BY rec_id")
feature_query("feat_f07_hapax_ratio", "hapax_ratio", _FREQ + " SELECT rec_id, round(100.0 * count(*) FILTER (WHERE c = 1) / any_value(n), 6) AS hapax_ratio FROM freq GROUP BY rec_id")
feature_query("feat_f08_lexical_cohesion", "lexical_cohesion", f"""
, sets AS (SELECT rec_id, k, list_transform(sents, lambda s: list_distinct(list_filter(s, lambda w: regexp_full_match(w, '[\\p{{L}}\\p{{Mn}}]+') AND w NOT IN {_in(f.FUNCTION)} AND w NOT IN {_in(f.AUXILIARY)}))) AS xs FROM docs)
SELECT rec_id, round(CASE WHEN k > 1 THEN list_sum(list_transform(range(1, k), lambda i: CASE WHEN len(xs[i]) > 0 AND len(xs[i + 1]) > 0 THEN len(list_intersect(xs[i], xs[i + 1])) / least(len(xs[i]), len(xs[i + 1])) ELSE 0.0 END)) / (k - 1) ELSE 0 END, 6) AS lexical_cohesion FROM sets""")
feature_query("feat_f09_referential_density", "referential_density", _share(f"w IN {_in(f.REFERRING)}", "referential_density"))
_DEP = f"""
, sent AS (SELECT rec_id, k, unnest(sents) AS s, unnest(range(1, k + 1)) AS no FROM docs)
, rooted AS (SELECT *, coalesce(list_position(list_transform(s, lambda w: w IN {_in(f.AUXILIARY)}), true), 1) AS root FROM sent)
, r2 AS (SELECT *, CASE WHEN root = 0 THEN 1 ELSE root END AS rt FROM rooted)
, heads AS (SELECT rec_id, k, no, rt, list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i = rt THEN i WHEN s[i] NOT IN {_in(f.FUNCTION)} THEN rt
   ELSE coalesce(list_min(list_filter(range(i + 1, len(s) + 1), lambda j: j = rt OR s[j] NOT IN {_in(f.FUNCTION)})), rt) END) AS h FROM r2)
"""
feature_query("feat_f10_mdd", "mdd", _DEP + ", d AS (SELECT rec_id, k, coalesce(list_avg(list_filter(list_transform(range(1, len(h) + 1), lambda i: abs(i - h[i])), lambda x: x > 0)), 0) AS v FROM heads) SELECT rec_id, round(sum(v) / any_value(k), 6) AS mdd FROM d GROUP BY rec_id")
feature_query("feat_f11_tree_depth", "tree_depth", _DEP + ", d AS (SELECT rec_id, k, list_max(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN i = rt THEN 1 WHEN h[i] = rt THEN 2 ELSE 3 END)) AS v FROM heads) SELECT rec_id, round(sum(v) / any_value(k), 6) AS tree_depth FROM d GROUP BY rec_id")
feature_query("feat_f12_nominalization_rate", "nominalization_rate", _share("regexp_matches(w, '(" + "|".join(f.NOMINAL) + ")$')", "nominalization_rate"))
feature_query("feat_f13_passive_ratio", "passive_ratio", f" SELECT rec_id, round(list_sum(list_transform(sents, lambda s: len(list_filter(range(1, len(s)), lambda i: s[i] IN {_in(f.BE)} AND (s[i + 1] LIKE '%ed' OR s[i + 1] IN {_in(f.IRREGULAR)}))))) / k, 6) AS passive_ratio FROM docs")
feature_query("feat_f14_discourse_density", "discourse_density", _share(f"w IN {_in(f.DISCOURSE)}", "discourse_density"))
feature_query("feat_f15_pronoun_ratio", "pronoun_ratio", _share(f"w IN {_in(f.PERSONAL)}", "pronoun_ratio"))
feature_query("feat_f16_fkgl", "fkgl", " SELECT rec_id, round(0.39 * n / k + 11.8 * list_sum(list_transform(words, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND w NOT LIKE '%le' THEN 1 ELSE 0 END))) / n - 15.59, 6) AS fkgl FROM docs")


@query("feat_f22_sentences", SENTS + " SELECT rec_id, CAST(no AS BIGINT) AS sentence, CAST(len(s) AS BIGINT) AS words FROM (SELECT rec_id, unnest(sents) AS s, unnest(range(1, k + 1)) AS no FROM docs)")
def sentences(spark, sf):
    """The token table by sentence, by Spark's own expressions."""
    g = generated(spark, sf).where("length(generated_text) >= 10")
    cut = F.filter(F.transform(F.regexp_extract_all(F.lower("generated_text"), F.lit("[^.!?\n]+"), F.lit(0)), lambda s: F.regexp_extract_all(s, F.lit("[\\p{L}\\p{N}]+(?:['’-][\\p{L}\\p{N}]+)*"), F.lit(0))), lambda w: F.size(w) > 0)
    return g.select("rec_id", F.posexplode(cut).alias("at", "w")).select("rec_id", (F.col("at") + 1).cast("long").alias("sentence"), F.size("w").cast("long").alias("words"))


_WORDS_SPARK = "[\\p{L}\\p{N}]+(?:['’-][\\p{L}\\p{N}]+)*"
_TOKENS = f"WITH tok AS (SELECT rec_id, unnest(regexp_extract_all(lower(generated_text), '{_WORD}')) AS w FROM generated_corpus WHERE length(generated_text) >= 10)"


def tokens(spark, sf):
    """(rec_id, w) of the generated texts."""
    g = generated(spark, sf).where("length(generated_text) >= 10")
    return g.select("rec_id", F.explode(F.regexp_extract_all(F.lower("generated_text"), F.lit(_WORDS_SPARK), F.lit(0))).alias("w"))


def lexicon(spark, sf):
    """(word, level): lower-cased words, of equal ones the last line holds."""
    lex = table(spark, sf, "cefr_lexicon").where("word is not null")
    return lex.groupBy(F.lower("word").alias("word")).agg(F.max_by("level", "line_no").alias("level"))


_LEX = "lex AS (SELECT lower(word) AS word, arg_max(level, line_no) AS level FROM cefr_lexicon WHERE word IS NOT NULL GROUP BY 1)"


@query("scan_s10_level_lexicon", f"WITH {_LEX} SELECT * FROM lex")
def level_lexicon(spark, sf):
    return lexicon(spark, sf)


@query("agg_a18_word_frequencies", _TOKENS + " SELECT rec_id, w AS word, count(*) AS n FROM tok GROUP BY ALL")
def word_frequencies(spark, sf):
    return tokens(spark, sf).groupBy("rec_id", F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("win_w05_top_words", _TOKENS + ", c AS (SELECT w, count(*) AS n FROM tok GROUP BY w) SELECT w AS word, n FROM c ORDER BY n DESC, w LIMIT 20")
def top_words(spark, sf):
    """The twenty most frequent words of the corpus."""
    return tokens(spark, sf).groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(20)


_STEM = "CASE WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%s' THEN left(w, length(w) - 1) WHEN w LIKE '%ing' THEN left(w, length(w) - 3) WHEN w LIKE '%ed' THEN left(w, length(w) - 2) ELSE w END"


def stem(w):
    """The form looked up when the surface form isn't there: a plain ending cut off."""
    cut = lambda n: F.expr(f"left({w}, length({w}) - {n})")
    c = F.col(w)
    return F.when(c.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(c.endswith("s"), cut(1)).when(c.endswith("ing"), cut(3)).when(c.endswith("ed"), cut(2)).otherwise(c)


def levels(spark, sf):
    """(rec_id, w, level) of each token: by its surface form, then its stem, else Off-List; tokens that aren't only letters have none."""
    lex = F.broadcast(lexicon(spark, sf))  # some hundreds of words
    one = tokens(spark, sf).groupBy("rec_id", "w").agg(F.count(F.lit(1)).alias("k"))
    rows = one.join(lex.withColumnRenamed("word", "w"), "w", "left").withColumn("s", stem("w")).join(lex.select(F.col("word").alias("s"), F.col("level").alias("second")), "s", "left")
    return rows.select("rec_id", "w", "k", F.when(F.col("w").rlike(r"^\p{L}+$"), F.coalesce("level", "second", F.lit("Off-List"))).alias("level"))


_LEVELS = _TOKENS + f", {_LEX}, lev AS (SELECT rec_id, w, CASE WHEN regexp_full_match(w, '\\p{{L}}+') THEN coalesce(a.level, b.level, 'Off-List') END AS level FROM tok LEFT JOIN lex a ON a.word = w LEFT JOIN lex b ON b.word = {_STEM})"


@query("join_j11_fallback_lookup", _LEVELS + " SELECT level, count(*) AS n FROM lev GROUP BY level")
def fallback_lookup(spark, sf):
    """how many tokens each level gets by the two-step lookup."""
    return levels(spark, sf).groupBy("level").agg(F.sum("k").alias("n"))


@query("feat_f03_level_shares", _LEVELS + " SELECT rec_id, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE level = '{x}') / count(*), 6) AS cefr_{x.lower()}" for x in ("A1", "A2", "B1", "B2", "C1")) + " FROM lev GROUP BY rec_id")
def level_shares(spark, sf):
    share = lambda x: F.round(100.0 * F.coalesce(F.sum(F.when(F.col("level") == x, F.col("k"))), F.lit(0)) / F.sum("k"), 6).alias(f"cefr_{x.lower()}")
    return levels(spark, sf).groupBy("rec_id").agg(*map(share, ("A1", "A2", "B1", "B2", "C1")))


@query("feat_f04_advanced_share", _LEVELS + " SELECT rec_id, round(100.0 * count(*) FILTER (WHERE level IN ('C1', 'C2')) / count(*), 6) AS avd_combined FROM lev GROUP BY rec_id")
def advanced_share(spark, sf):
    return levels(spark, sf).groupBy("rec_id").agg(F.round(100.0 * F.coalesce(F.sum(F.when(F.col("level").isin("C1", "C2"), F.col("k"))), F.lit(0)) / F.sum("k"), 6).alias("avd_combined"))


def _sql_pattern(p: str) -> str:
    return p.replace("'", "''")


_RULES = list(t.ERROR_PATTERNS.items())[2:]


@query("text_t05_rule_errors", "SELECT rec_id, " + ", ".join(f"CAST(len(regexp_extract_all(regexp_replace(generated_text, '[^\\P{{L}}a-zA-Z]|[^\\P{{M}}]|[^\\P{{N}}0-9]', '9', 'g'), '(?i){_sql_pattern(p)}')) AS BIGINT) AS rule_{i + 3}" for i, (_, p) in enumerate(_RULES)) + " FROM generated_corpus WHERE generated_text IS NOT NULL")
def rule_errors(spark, sf):
    """The five patterns that SQL engines without look-around can count."""
    c = t.error_counts(F.col("generated_text"))
    return generated(spark, sf).where("generated_text is not null").select("rec_id", *(c[n].alias(f"rule_{i + 3}") for i, (n, _) in enumerate(_RULES)))


@query("feat_f18_grammar_error_rate")
def grammar_error_rate(spark, sf):
    """100 times all seven patterns' count over the words; look-behind and back-references have no SQL here, so tests hold it against Python."""
    g = generated(spark, sf).where("length(generated_text) >= 10")
    n = F.regexp_count("generated_text", F.lit(_WORDS_SPARK))
    total = sum(t.error_counts(F.col("generated_text")).values(), F.lit(0))
    return g.where(n > 0).select("rec_id", F.round(100.0 * total / n, 6).alias("grammar_error_rate"))


@query("text_t01_one_line", "SELECT rec_id, md5(trim(regexp_replace(regexp_replace(generated_text, '[\\r\\n]+', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM generated_corpus")
def one_line(spark, sf):
    return generated(spark, sf).select("rec_id", F.md5(t.one_line(F.col("generated_text"))).alias("digest"))


@query("text_t02_clean_text")
def clean_text(spark, sf):
    return generated(spark, sf).select("rec_id", t.cleaned(F.col("generated_text"), F.col("topic")).alias("cleaned"))


@query("text_t06_masked")
def masked(spark, sf):
    return table(spark, sf, "exemplar_pool").select("rec_id", t.masked(F.col("text")).alias("text"))


_ALL_MARKERS = sorted({w for ws in t.MARKERS.values() for w in ws}, key=lambda w: (-len(w), w))


@query("text_t07_marker_audit")
def marker_audit(spark, sf):
    """(region, marker, n_texts, occurrences, texts_with, percent) for every region and marker, zero where there is none."""
    p = table(spark, sf, "exemplar_pool").select("rec_id", F.split("file_name", "_")[1].alias("region"), t.markers_in(F.col("text")).alias("ms")).where("region is not null")
    sizes = p.groupBy("region").agg(F.count(F.lit(1)).alias("n_texts"))
    found = p.select("region", "rec_id", F.explode("ms").alias("marker")).groupBy("region", "marker").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("rec_id").alias("texts_with"))
    grid = sizes.withColumn("marker", F.explode(F.array(*map(F.lit, _ALL_MARKERS))))
    rows = grid.join(found, ["region", "marker"], "left").na.fill(0, ["occurrences", "texts_with"])
    return rows.select("region", "marker", "n_texts", "occurrences", "texts_with", F.round(100.0 * F.col("texts_with") / F.col("n_texts"), 6).alias("percent"))


@query("agg_a06_marker_peaks")
def marker_peaks(spark, sf):
    return marker_audit(spark, sf).groupBy("marker").agg(F.max("percent").alias("peak")).orderBy(F.desc("peak"), "marker")


@query("text_t12_truncated", "SELECT rec_id, length(substr(generated_text, 1, 3000)) AS chars, md5(substr(generated_text, 1, 3000)) AS digest FROM generated_corpus")
def truncated(spark, sf):
    """The bounded text that an outside parser is given; the limit is that parser's."""
    x = F.substring("generated_text", 1, 3000)
    return generated(spark, sf).select("rec_id", F.length(x).cast("long").alias("chars"), F.md5(x).alias("digest"))


@query("text_t14_sha256", "SELECT rec_id, upper(sha256(text)) AS digest FROM exemplar_pool")
def sha256(spark, sf):
    return table(spark, sf, "exemplar_pool").select("rec_id", F.upper(F.sha2("text", 256)).alias("digest"))


@query("text_t10_split_once", "SELECT DISTINCT key, split_part(key, '|', 1) AS writer, substr(key, length(split_part(key, '|', 1)) + 2) AS rest FROM l1_dataset")
def split_once(spark, sf):
    parts = F.split("key", r"\|", 2)
    return table(spark, sf, "l1_dataset").select("key", parts[0].alias("writer"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("rest")).distinct()


@query("text_t11_affixes", "SELECT DISTINCT dataset, regexp_replace(dataset, '^sim_', '') AS bare, replace(topic, ' ', '_') AS slug FROM l1_dataset")
def affixes(spark, sf):
    return table(spark, sf, "l1_dataset").select("dataset", F.regexp_replace("dataset", "^sim_", "").alias("bare"), F.replace("topic", F.lit(" "), F.lit("_")).alias("slug")).distinct()


@query("text_t15_t16_rounding", "SELECT rec_id, round(log2(1 + prompt_tokens), 4) AS log_tokens, round(sqrt(prompt_tokens), 4) AS root_tokens, round(greatest(0, least(prompt_tokens, 150)), 1) AS clipped FROM generated_corpus WHERE prompt_tokens IS NOT NULL")
def rounding(spark, sf):
    g = generated(spark, sf).where("prompt_tokens is not null")
    return g.select("rec_id", F.round(F.log2(1 + F.col("prompt_tokens")), 4).alias("log_tokens"), F.round(F.sqrt("prompt_tokens"), 4).alias("root_tokens"), F.round(F.greatest(F.lit(0), F.least("prompt_tokens", F.lit(150))), 1).alias("clipped"))


@query("text_t03_endings", _TOKENS + " SELECT w AS word, count(*) AS n FROM tok WHERE regexp_matches(w, '(" + "|".join(f.NOMINAL) + ")$') GROUP BY w")
def endings(spark, sf):
    return tokens(spark, sf).where(F.col("w").rlike("(" + "|".join(f.NOMINAL) + ")$")).groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("text_t04_token_in_set", _TOKENS + f" SELECT w AS word, count(*) AS n FROM tok WHERE w IN {_in(f.DISCOURSE)} GROUP BY w")
def token_in_set(spark, sf):
    return tokens(spark, sf).where(F.col("w").isin(f.DISCOURSE)).groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("text_t13_nested_json", """WITH m AS (SELECT rec_id, model_id, prompt_tokens, completion_tokens FROM generated_corpus)
SELECT rec_id, model_id AS model, CAST(coalesce(prompt_tokens, 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(completion_tokens, 0) AS BIGINT) AS completion_tokens FROM m""")
def nested_json(spark, sf):
    """Answers of a service as JSON text, read back by a schema with defaults for what is missing."""
    from ..sources.readers import answers

    g = generated(spark, sf)
    body = F.struct(F.col("model_id").alias("model"), F.array(F.struct(F.struct(F.col("generated_text").alias("content")).alias("message"))).alias("choices"), F.struct("prompt_tokens", "completion_tokens").alias("usage"))
    return answers(g.select("rec_id", F.to_json(body).alias("line")), "line").select("rec_id", "model", "prompt_tokens", "completion_tokens")


@query("text_t18_token_windows", "SELECT doc_id, CAST(no AS BIGINT) AS win, CAST(least(64, len(ids) - no * 64) AS BIGINT) AS size FROM (SELECT doc_id, ids, unnest(range(0, CAST(floor((greatest(len(ids), 1) - 1) / 64) AS BIGINT) + 1)) AS no FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS ids FROM documents)) WHERE len(ids) > 0 UNION ALL SELECT doc_id, 0, 1 FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) = 0")
def token_windows(spark, sf):
    """Windows of 64 word ids of each document; one window with the unknown id where there is none."""
    d = table(spark, sf, "documents")
    ids = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.pmod(F.hash(w), F.lit(30000)))
    return d.select("doc_id", F.posexplode(t.windows(ids, 64, 1)).alias("w", "ids")).select("doc_id", F.col("w").cast("long").alias("win"), F.size("ids").cast("long").alias("size"))


@query("win_w02_adjacent_sentences", SENTS + ", p AS (SELECT rec_id, unnest(range(1, k)) AS no, sents FROM docs WHERE k > 1) SELECT rec_id, CAST(no AS BIGINT) AS sentence, CAST(len(list_intersect(list_distinct(sents[no]), list_distinct(sents[no + 1]))) AS BIGINT) AS shared FROM p")
def adjacent_sentences(spark, sf):
    """U7 too: the words that each sentence shares with the next."""
    g = generated(spark, sf).where("length(generated_text) >= 10")
    cut = F.filter(F.transform(F.regexp_extract_all(F.lower("generated_text"), F.lit("[^.!?\n]+"), F.lit(0)), lambda s: F.array_distinct(F.regexp_extract_all(s, F.lit(_WORDS_SPARK), F.lit(0)))), lambda w: F.size(w) > 0)
    sets = g.select("rec_id", cut.alias("s")).where(F.size("s") > 1)
    pairs = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: F.size(F.array_intersect(a, b)))
    return sets.select("rec_id", F.posexplode(pairs).alias("at", "n")).select("rec_id", (F.col("at") + 1).cast("long").alias("sentence"), F.col("n").cast("long").alias("shared"))
