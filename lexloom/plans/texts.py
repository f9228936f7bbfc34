"""Tokenising, extraction, language, personal data, heuristic filters (T and F rows)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lexloom.functions.text import held, words
from lexloom.operators import markdown as K
from lexloom.plans.dialect import Plans
from lexloom.sources.files import blob_name
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add

both("word_counts", "select doc_id, SIZE(WORDS(text)) n_words from documents")
both("length_codepoints", "select doc_id, BIG(length(text)) n_chars, BYTES(text) n_bytes, SIZE(WSWORDS(text)) n_ws_words from documents")

# T-03: blocks of script, style, navigation and comments go, then tags, then entities
HTML_BLOCKS = "(?s)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<header.*?</header>|<footer.*?</footer>|<aside.*?</aside>|<!--.*?-->|<div class=.ad.>.*?</div>"
_STRIP = f"REPLACE_ALL(REPLACE_ALL(html, '{HTML_BLOCKS}', ' '), '<[^>]*>', ' ')"
_ENTITIES = f"replace(replace(replace(replace(replace({_STRIP}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')"
both("html_main_text", f"select page_id, trim(REPLACE_ALL({_ENTITIES}, '[ \t\r\n]+', ' ')) text from pages".replace("\t", "\\t").replace("\r", "\\r").replace("\n", "\\n"), None)
both("html_title_links", """select page_id, FIRST_RE(html, '<title>([^<]*)</title>', 1) title, COUNT_RE(html, 'href="([^"]*)"') n_links, COUNT_RE(html, '<h[1-6]') n_headings, FIRST_RE(html, 'lang="([a-z]+)"', 1) lang from pages""")
both("html_links", """select page_id, link, count(*) n from (select page_id, EACH(regexp_extract_all(html, 'href="([^"]*)"', 1)) link from pages) t group by page_id, link""")
both("html_wrap", "select page_id, concat('<nav>', url, '</nav>', chr(10), '<footer>', url, '</footer>') wrapped from pages")
both("url_parts", "select page_id, FIRST_RE(url, '^([a-z]+)://', 1) scheme, FIRST_RE(url, '://([^/?#]+)', 1) host, FIRST_RE(url, '://[^/?#]+([^?#]*)', 1) path, FIRST_RE(url, '[?]([^#]*)', 1) query from pages")

#: Frequent function words by language.
STOPWORDS = {
    "en": "the and of to in that is was for on are with as his they be at this from have or by one had not but what all were when we there can an your which their if do will each about how up out them then she many some so these would other into has more",
    "fr": "le la les de des du un une et est que qui dans pour sur avec pas plus par au ce ne se son sa ses il elle nous vous leur mais ou donc",
    "de": "der die das und ist nicht ein eine zu den dem mit sich auf von im des für als auch es an werden aus er hat dass sie nach wird bei",
    "es": "el la los las de que y en un una por con no para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre",
}
_ALPHA = {"spark": r"regexp_extract_all(lower(text), '([a-zàâäçéèêëîïôöùûüÿñáíóúß]+)', 1)", "duck": "regexp_extract_all(lower(text), '[a-zàâäçéèêëîïôöùûüÿñáíóúß]+')"}


def _langid(kind: str) -> str:
    score = lambda ws: f"(size(filter(w, e -> e in ({ws})))" if kind == "spark" else f"(len(list_filter(w, lambda e: e in ({ws})))"
    cols = ", ".join(score(", ".join(f"'{x}'" for x in sorted(set(ws.split())))) + f") s_{lang}" for lang, ws in STOPWORDS.items())
    return (
        f"with t as (select lang, {_ALPHA[kind]} w from documents), s as (select lang, {cols} from t), "
        "g as (select lang, case greatest(s_en, s_fr, s_de, s_es) when 0 then 'und' when s_en then 'en' when s_fr then 'fr' when s_de then 'de' else 'es' end predicted from s) "
        "select lang, predicted, count(*) n from g group by lang, predicted"
    )


both("langid_confusion", _langid("duck"), _langid("spark"))

LETTERS = "[a-zàâäçéèêëîïôöùûüÿñáíóúß]+"


def language_scores(text):
    """Shares of a text's words that are each language's function words: {language: column}; 0 without words."""
    w = F.regexp_extract_all(F.lower(text), F.lit(f"({LETTERS})"), F.lit(1))
    return w, {k: sorted(set(v.split())) for k, v in STOPWORDS.items()}


def _langid_filter(spark, d, least=0.1):
    """Documents whose likeliest language (ties in the order of STOPWORDS) is theirs and has a share of function words of `least` or more."""
    w, lists = language_scores(F.col("text"))
    t = held(table(spark, d, "documents").select("doc_id", "lang", "text"), "w", w).where(F.size("w") > 0)
    inside = lambda v: lambda x: x.isin(v)
    score = [(F.size(F.filter("w", inside(v))) / F.size("w")).alias(f"s_{k}") for k, v in lists.items()]
    t = held(t, "s", F.struct(*score)).select("doc_id", "lang", "s.*")  # held: else the shares go into the filter, before it asks for words
    top = F.greatest(*[F.col(f"s_{k}") for k in lists])
    best = F.coalesce(*[F.when(F.col(f"s_{k}") == top, F.lit(k)) for k in lists])
    return t.select("doc_id", "lang", best.alias("predicted"), F.round(top, 6).alias("share")).where((F.col("predicted") == F.col("lang")) & (F.col("share") >= least))


def _langid_filter_sql(least=0.1):
    cols = ", ".join(f"len(list_filter(w, lambda e: e in ({', '.join(repr(x) for x in sorted(set(v.split())))})))::double / len(w) s_{k}" for k, v in STOPWORDS.items())
    best = "case " + " ".join(f"when s_{k} = top then '{k}'" for k in STOPWORDS) + " end"
    return f"with t as (select doc_id, lang, {_ALPHA['duck']} w from documents), s as (select doc_id, lang, {cols} from t where len(w) > 0), g as (select *, greatest({', '.join('s_' + k for k in STOPWORDS)}) top from s), b as (select doc_id, lang, {best} predicted, round(top, 6) share from g) select doc_id, lang, predicted, share from b where predicted = lang and share >= {least}"


add("langid_filter", _langid_filter, _langid_filter_sql())

#: Detection patterns of personal data, without look-around so that both regex engines agree.
EMAIL, PHONE, SSN, IPV4 = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "[+][0-9][0-9 ().-]{7,}[0-9]", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
STREET = "[0-9]{1,5} [A-Z][a-z]+ (Street|Avenue|Road|Lane|Drive|Boulevard)"
both("pii_flags", f"select doc_id, COUNT_RE(text, '{STREET}') n_street, COUNT_RE(text, '{EMAIL}') n_email, COUNT_RE(text, '{PHONE}') n_phone, COUNT_RE(text, '{SSN}') n_ssn, COUNT_RE(text, '{IPV4}') n_ip from documents")
both("pii_masked", f"select doc_id, md5(REPLACE_ALL(REPLACE_ALL(REPLACE_ALL(REPLACE_ALL(text, '{EMAIL}', '<EMAIL>'), '{IPV4}', '<IP>'), '{PHONE}', '<PHONE>'), '{SSN}', '<SSN>')) masked_md5 from documents")
both("pii_dropped", f"select doc_id from documents where not MATCHES(text, '{EMAIL}') and not MATCHES(text, '{PHONE}') and not MATCHES(text, '{SSN}') and not MATCHES(text, '{IPV4}') and not MATCHES(text, '{STREET}')")
both("license_lines", "select doc_id, line, count(*) n from (select doc_id, EACH(LINES(text)) line from documents) t where MATCHES(line, '(?i)licen[cs]e|copyright|all rights reserved') group by doc_id, line")
both("secret_lines", "select doc_id, count(*) n from (select doc_id, EACH(LINES(text)) line from documents) t where MATCHES(line, '(?i)(password|secret|token|api_?key) *[:=]|AKIA[A-Z0-9]{14}') group by doc_id")
both("error_pages", "select page_id, MATCHES(html, '(?i)page not found|404 not found|javascript is disabled|lorem ipsum') is_error from pages")
add("slugs", lambda s, d: table(s, d, "benchmark").select("item_id", F.posexplode(K.lines(F.col("text")))).select("item_id", F.col("pos").cast("long").alias("line"), K.slug(F.col("col")).alias("slug")), r"select item_id, (generate_subscripts(l, 1) - 1)::bigint line, replace(trim(regexp_replace(lower(regexp_replace(regexp_replace(unnest(l), '(^|[^!])\[([^\]]*)\]\(([^)\s]+)[^)]*\)', '\1\2', 'g'), '[`*_]', '', 'g')), '[^\p{L}\p{N} -]', '', 'g')), ' ', '-') slug from (select item_id, string_split(text, chr(10)) l from benchmark)")
both("synonym_paraphrase", "select item_id, REPLACE_ALL(REPLACE_ALL(REPLACE_ALL(concat(' ', lower(text), ' '), ' the ', ' this '), ' and ', ' plus '), ' of ', ' from ') paraphrase from benchmark")
both("caesar_translate", "select item_id, translate(JOINED(WORDS(text), ' '), 'abcdefghijklmnopqrstuvwxyz', 'hijklmnopqrstuvwxyzabcdefg') translated from benchmark")
add("git_blob_names", lambda s, d: table(s, d, "documents").select("doc_id", blob_name(F.encode("text", "UTF-8")).alias("name")), "select doc_id, sha1(concat('blob ', cast(strlen(text) as varchar), chr(0), text)) name from documents")
both("byte_ids", "select conv_id, turn, BYTES(text) + 2 n_ids, BIG(ascii(text)) first_code from conversations where text <> ''")


def _nfc(spark, d):
    import unicodedata

    @pandas_udf("string")
    def nfc(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return table(spark, d, "documents").select("doc_id", F.md5(nfc("text")).alias("nfc_md5"))


P.add("nfc_normalised", _nfc, "select doc_id, md5(nfc_normalize(text)) nfc_md5 from documents")

# T-10, T-12: code fences and cells of percent-format notebooks; the tables have few of either, tests have more


def _fenced(spark, d):
    f = held(table(spark, d, "documents").select("doc_id", "text"), "f", K.fenced(F.col("text")))
    return f.select("doc_id", F.size("f.outside").cast("long").alias("n_outside"), F.size("f.inside").cast("long").alias("n_inside"))


_LINE_SQL = "l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents)"
add("fenced_lines", _fenced, f"with {_LINE_SQL}, m as (select doc_id, pos, regexp_matches(line, '^\\s*(```|~~~)') mark from l), c as (select doc_id, mark, sum(mark::int) over (partition by doc_id order by pos) n from m) select doc_id, count(*) filter (where not mark and n % 2 = 0) n_outside, count(*) filter (where not mark and n % 2 = 1) n_inside from c group by doc_id")


def _cells(spark, d):
    c = held(table(spark, d, "documents").select("doc_id", "text"), "c", K.cells(F.col("text"), "^#"))
    return c.select("doc_id", F.posexplode("c").alias("cell", "x")).select("doc_id", F.col("cell").cast("long").alias("cell"), "x.kind", F.md5("x.source").alias("source_md5"))


add("cells_by_marker", _cells, f"with {_LINE_SQL}, m as (select doc_id, pos, line, sum(starts_with(line, '#')::int) over (partition by doc_id order by pos) cell from l) select doc_id, (cell - 1)::bigint cell, case when contains(arg_min(line, pos), '[markdown]') then 'markdown' else 'code' end kind, md5(coalesce(string_agg(line || chr(10), '' order by pos) filter (where not starts_with(line, '#')), '')) source_md5 from m where cell > 0 group by doc_id, cell")
both("json_block_staleness", "select event_id, JSONK(props) k, JSONK(props) is not distinct from event_id % 100 is_current from events", "select event_id, JSONK(props) k, JSONK(props) <=> event_id % 100 is_current from events")
both("han_vocab", "select lang, COUNT_IF(MATCHES(text, '[\u4e00-\u9fff]')) n_han, COUNT_IF(MATCHES(text, '[\u00e0-\u00ff]')) n_latin1 from documents group by lang")

# T-17: longest common run of words between a document and each benchmark item, by diagonals
# a common word pairs with every occurrence of itself; runs of four words start from shared four-grams instead
_RUN = """with d as (select doc_id, WORDS(text) w from documents), b as (select item_id, WORDS(text) w from benchmark),
dg as ({dg}), bg as ({bg}),
m as (select doc_id, item_id, i - j diag, i from dg join bg using (g)),
g as (select doc_id, item_id, diag, i - row_number() over (partition by doc_id, item_id, diag order by i) run from m),
r as (select doc_id, item_id, count(*) + 3 len from g group by doc_id, item_id, diag, run)
select doc_id, item_id, max(len) longest from r group by doc_id, item_id"""
_GRAM = {
    "duck": "select {k}, i, array_to_string(w[i:i + 3], ' ') g from (select {k}, w, unnest(range(1, len(w) - 2)) i from {t}) x",
    "spark": "select {k}, {i}, array_join(slice(w, {i}, 4), ' ') g from (select {k}, w, explode(sequence(1, size(w) - 3)) {i} from {t} where size(w) >= 4) x",
}
both(
    "longest_common_run",
    _RUN.format(dg=_GRAM["duck"].format(k="doc_id", t="d"), bg=_GRAM["duck"].format(k="item_id", t="b").replace(", i, array", ", i j, array")),
    _RUN.format(dg=_GRAM["spark"].format(k="doc_id", t="d", i="i"), bg=_GRAM["spark"].format(k="item_id", t="b", i="j")),
)

# F rows
_W = "with t as (select doc_id, text, lang, source, WSWORDS(text) w, LINES(text) l from documents) "
both("filter_word_count", _W + "select doc_id, SIZE(w) n_words from t where SIZE(w) between 50 and 100000")
# Spark computes the quotient before it asks for SIZE(w) > 0, as it is used more than once: there texts without words divide by null
_MEAN = "select doc_id, DBL(length(replace(JOINED(w, ' '), ' ', ''))) / SIZE(w) mean_len from t where SIZE(w) > 0 and DBL(length(replace(JOINED(w, ' '), ' ', ''))) / SIZE(w) between 3 and 10"
both("filter_mean_word_length", _W + _MEAN, _W + _MEAN.replace("/ SIZE(w)", "/ nullif(SIZE(w), 0)"))
both("filter_symbol_ratio", _W + "select doc_id, DBL(COUNT_RE(text, '[!@#$%^&*()]')) / SIZE(w) ratio from t where SIZE(w) > 0 and COUNT_RE(text, '[!@#$%^&*()]') <= 0.1 * SIZE(w)")
both("filter_line_punctuation", "select doc_id, BIG(sum(case when MATCHES(line, '[.!?]$') then 1 else 0 end)) n_ended, count(*) n_lines from (select doc_id, EACH(LINES(text)) line from documents) t group by doc_id")
both("filter_upper_case", "select doc_id, COUNT_RE(text, '\\p{Lu}') * 2 > COUNT_RE(text, '\\p{L}') mostly_upper from documents", "select doc_id, COUNT_RE(text, '\\\\p{Lu}') * 2 > COUNT_RE(text, '\\\\p{L}') mostly_upper from documents")
both("heuristic_features", _W + """select doc_id, SIZE(w) n_words, SIZE(l) n_lines, DBL(SIZE(w)) / SIZE(l) words_per_line, 1 - DBL(SIZE(DISTINCT_OF(l))) / SIZE(l) repeated_lines,
DBL(SIZE(DISTINCT_OF(w))) / case when SIZE(w) = 0 then 1 else SIZE(w) end unique_words, R6(LN(1 + SIZE(w))) log_words, COUNT_RE(text, '[.!?]') n_sentence_ends, DBL(SIZE(w)) / greatest(1, COUNT_RE(text, '[.!?]')) words_per_sentence, DBL(COUNT_RE(concat(chr(10), text), '\\n[A-Z]')) / SIZE(l) capital_lines from t""",
    _W + """select doc_id, SIZE(w) n_words, SIZE(l) n_lines, DBL(SIZE(w)) / SIZE(l) words_per_line, 1 - DBL(SIZE(DISTINCT_OF(l))) / SIZE(l) repeated_lines,
DBL(SIZE(DISTINCT_OF(w))) / case when SIZE(w) = 0 then 1 else SIZE(w) end unique_words, R6(LN(1 + SIZE(w))) log_words, COUNT_RE(text, '[.!?]') n_sentence_ends, DBL(SIZE(w)) / greatest(1, COUNT_RE(text, '[.!?]')) words_per_sentence, DBL(size(filter(l, x -> x rlike '^[A-Z]'))) / SIZE(l) capital_lines from t""")
both("word_length_spread", "select doc_id, BIG(count(*)) n, BIG(sum(length(word))) total, BIG(sum(length(word) * length(word))) squares, R6(sqrt(greatest(0, DBL(sum(length(word) * length(word))) / count(*) - pow(DBL(sum(length(word))) / count(*), 2)))) std_len from (select doc_id, EACH(WSWORDS(text)) word from documents) t group by doc_id")
both("langid_share", "select doc_id, lang, SIZE(WORDS(text)) n, COUNT_RE(lower(text), '[éèêàçùñáíóúäöüß]') n_marked from documents where length(text) > 0")
both("toxicity_filter", "select d.doc_id, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id where l.toxic = 0")
both("toxicity_lexical", "select doc_id, COUNT_RE(lower(text), 'worthless|trash|disgusting|scum') n_hits from documents where MATCHES(lower(text), 'worthless|trash|disgusting|scum')")
# F-11: the cut is the order statistic int(0.3 n), kept at or above
_CUT = "with s as (select doc_id, SIZE(WORDS(text)) score from documents), r as (select score, row_number() over (order by score, doc_id) rn, count(*) over () n from s), c as (select score cut from r where rn = BIG(floor(0.3 * n)) + 1) select doc_id, score from s cross join c where score >= cut"


def _percentile_cut(spark, d):
    # the order statistic without one window over all rows: counts by score, running sums over the distinct scores
    from pyspark.sql import Window

    from lexloom.functions.text import words

    s = table(spark, d, "documents").select("doc_id", F.size(words(F.col("text"))).cast("long").alias("score"))
    by = s.groupBy("score").agg(F.count("*").alias("n"))
    run = by.select("score", F.sum("n").over(Window.orderBy("score")).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    cut = run.where(F.col("upto") > F.floor(F.col("total") * 0.3)).agg(F.min("score").alias("cut"))
    return s.crossJoin(F.broadcast(cut)).where("score >= cut").select("doc_id", "score")


P.add("percentile_cut", _percentile_cut, _CUT)
both("percentile_top40", "with s as (select doc_id, DBL(SIZE(WORDS(text))) score from documents), c as (select quantile_cont(score, 0.6) cut from s) select doc_id, score from s cross join c where score >= round(cut, 9)", "with s as (select doc_id, DBL(SIZE(WORDS(text))) score from documents), c as (select percentile(score, 0.6) cut from s) select doc_id, score from s cross join c where score >= round(cut, 9)")
_FUNNEL = "with f as (select SIZE(WSWORDS(text)) >= 50 a, COUNT_RE(text, '[#*$%&|<>]') * 10 < SIZE(WSWORDS(text)) b, COUNT_RE(text, '[.!?]') > 0 c, BYTES(text) n from documents) "
both("heuristic_funnel", _FUNNEL + "select 0 stage, count(*) n_docs, BIG(sum(n)) n_bytes from f union all select 1, COUNT_IF(a), BIG(sum(case when a then n else 0 end)) from f union all select 2, COUNT_IF(a and b), BIG(sum(case when a and b then n else 0 end)) from f union all select 3, COUNT_IF(a and b and c), BIG(sum(case when a and b and c then n else 0 end)) from f")
_BIAS = "with f as (select lang, source, SIZE(WSWORDS(text)) < 50 a, COUNT_RE(text, '[#*$%&|<>]') * 10 >= SIZE(WSWORDS(text)) b from documents) "
both("filter_bias_by_lang", _BIAS + "select lang, COUNT_IF(a) dropped_short, COUNT_IF(b) dropped_symbols, count(*) n, DBL(COUNT_IF(a)) / count(*) rate_short from f group by lang")
both("filter_bias_cube", _BIAS + "select lang, source, COUNT_IF(a or b) dropped, count(*) n from f group by cube (lang, source)")
both("funnel_arithmetic", "select R6(100.0 * 0.15 * 0.45 * 0.25 * 0.40) petabytes")
