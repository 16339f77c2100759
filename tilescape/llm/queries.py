"""Registered queries: thin steps from the given tables to the operators' records and back."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (archives, fill_middle, line_runs, mixing, notices, packing, periodic_runs, pivot_index, quality_rules, shingle_forest, token_records,
               toxicity, url_rules)
from ._common import read, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as extracts: the language stands for the area."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("extract_id"), F.col("lang").alias("area"), "source", "text")


# -- Addresses ----------------------------------------------------------------

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op4_url_rules", r"""
    with p as (select page_id, coalesce(translate(nullif(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
         r(h, b, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
         m as (select p.*, h || b as rule, verdict, row_number() over (partition by page_id order by length(h || b) desc, length(h) desc) as k
               from p left join r on (host = h or host like '%.' || h) and starts_with(path, b))
    select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1""")
def op4(spark, sf):
    fetches = read(spark, sf, "pages").select(F.col("page_id").alias("fetch_id"), "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(fetches, rules).withColumnRenamed("fetch_id", "page_id")


# -- Token files --------------------------------------------------------------

@query("op5_token_records")
def op5(spark, sf):
    folder = shared_folder(spark, "token-records")
    token_records.write_token_records(extracts(spark, sf), folder, tokenizer_path(), 2)
    return token_records.read_token_records(spark, folder).withColumnRenamed("extract_id", "doc_id")


@query("op8_packing")
def op8(spark, sf):
    return packing.pack_extracts(extracts(spark, sf), tokenizer_path(), 0, 1024).withColumnRenamed("extract_id", "doc_id")


# -- Quality ------------------------------------------------------------------

def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("extract_id"), (F.col("quality") == 1).alias("good"))


def _quality_sql() -> str:
    """The measures by plain SQL, and binomial bounds by the log-gamma function."""
    tests = [(r, k, c, m) for r, (m, cs) in quality_rules.RULES.items() for k, c in enumerate(cs)]
    ratio = {r: m.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)") for r, (m, _) in quality_rules.RULES.items()}
    lost = " union all ".join(f"select area, '{r}' as rule, {k} as k, {c}e0 as cut, count(*) as n, count(*) filter ({ratio[r]} > {c}e0) as x from h group by 1" for r, k, c, _ in tests)
    over = " or ".join(f"coalesce({ratio[r]} > cut_{r}, false)" for r in ratio)
    cuts = ", ".join(f"min(cut) filter (rule = '{r}') as cut_{r}" for r in ratio)
    return f"""
    with w as (select doc_id, lang as area, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
         g as (select doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] as gram from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w) u),
         c as (select doc_id, count(distinct i + d) as n_repeat_words from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) q, (select unnest([0, 1, 2]) as d) o where n > 1 group by 1),
         m as (select doc_id, area, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                      len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join c using (doc_id)),
         b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
         h as (select * from b where not base_failed and area is not null and doc_id in (select doc_id from labels group by 1 having min(quality) = 1)),
         x as ({lost}),
         p as (select *, x < n * 0.005e0 and list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005e0) + (n - i) * ln(0.995e0)) for i in range(x + 1)])
                         <= 0.05e0 / ((select count(distinct area) from h) * {len(ratio)}) as ok from x),
         f as (select area, {cuts} from (select *, min(ok) over (partition by area, rule order by k) as so_far from p) q where so_far group by 1)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({over}) as kept, b.area, n_lines
    from b left join f on b.area = f.area"""


@query("op9_quality_rules", _quality_sql())
def op9(spark, sf):
    judged = quality_rules.judge_extracts(extracts(spark, sf), quality_verdicts(spark, sf))
    return judged.select(F.col("extract_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "area", "n_lines")


# -- Archives -----------------------------------------------------------------

@query("op1_archives", """
    with d as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
         e as (select page_id, body, hex, max(page_id) over (partition by hex) as latest from d)
    select page_id, strlen(body) as payload_bytes, case when page_id is not distinct from latest then 'response' else 'revisit' end as record_type,
           case when page_id is distinct from latest then latest end as refers_to,
           array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || hex[5 * i + 1:5 * i + 5] as bigint) >> s) & 31 as bigint) + 1, 1)
                            for s in [15, 10, 5, 0]] for i in range(8)]), '') as payload_digest
    from e""")
def op1(spark, sf):
    fetches = read(spark, sf, "pages").select(F.col("page_id").alias("fetch_id"), "url", F.col("html").alias("body"))
    raw, out = shared_folder(spark, "archives-raw"), shared_folder(spark, "archives")
    archives.write_archives(fetches, raw)
    archives.normalise_archives(spark, raw, out)
    return archives.read_archives(spark, out).withColumnRenamed("fetch_id", "page_id")


# -- Line runs ----------------------------------------------------------------

@query("op2_line_runs", r"""
    with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
         w as (select doc_id, i, trim(line, E' \t\x0b\f\r') as line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from l),
         c as (select *, sum(words) over (partition by doc_id order by i) as stop from w where words > 0),
         r as (select doc_id, i as lo, max(i) over f as hi, sum(words) over f as n, string_agg(line, chr(10)) over f as content from c
               window f as (partition by doc_id order by stop - words range between current row and 49 following)
               union all select doc_id, min(i) over f, i, sum(words) over f, string_agg(line, chr(10)) over f from c
               window f as (partition by doc_id order by stop range between 49 preceding and current row)),
         d as (select distinct doc_id, lo, hi, content from r where n >= 50),
         e as (select *, row_number() over (partition by content order by doc_id, lo, hi) as k from d),
         x as (select distinct l.doc_id, l.i from l join e on l.doc_id = e.doc_id and l.i between lo and hi and k > 1),
         k as (select l.doc_id, string_agg(line, chr(10) order by l.i) filter (x.i is null) as text, count(*) as n_lines, count(x.i) as n_removed
               from l left join x on l.doc_id = x.doc_id and l.i = x.i group by 1)
    select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed
    from documents d left join k using (doc_id)""")
def op2(spark, sf):
    return line_runs.drop_repeated_runs(extracts(spark, sf).select("extract_id", "text")).withColumnRenamed("extract_id", "doc_id")


# -- Near copies --------------------------------------------------------------

@query("op3_near_copies", r"""
    with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
         s as (select distinct doc_id, unnest(case when len(ws) < 5 then [array_to_string(ws, chr(10))] else [array_to_string(ws[i:i + 4], chr(10)) for i in range(1, len(ws) - 3)] end) as g from w),
         n as (select doc_id, count(*) as n from s group by 1),
         p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
         l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8e0 * (x.n + y.n - c) - 1e-9),
         reach as (select doc_id as a, doc_id as b from documents union select reach.a, l.b from reach join l on reach.b = l.a),
         k as (select a as doc_id, min(b) as class_id, count(*) as class_size from reach group by 1),
         d as (select a as doc_id, count(*) as n_links from l group by 1)
    select doc_id, class_id, class_size, coalesce(n_links, 0) as n_links, class_id = doc_id as kept from k left join d using (doc_id)""")
def op3(spark, sf):
    near = shingle_forest.near_extracts(extracts(spark, sf))
    return near.select(F.col("extract_id").alias("doc_id"), "class_id", "class_size", "n_links", F.col("first").alias("kept"))


# -- Neighbours ---------------------------------------------------------------

@query("op7_nearest_vectors")
def op7(spark, sf):
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"))
    found = pivot_index.nearest_vectors(vectors, vectors.filter("vector_id % 20 = 0"), k=20)
    return found.withColumnRenamed("vector_id", "vec_id")


# -- Notices ------------------------------------------------------------------

@query("op10_notices")
def op10(spark, sf):
    templates = spark.createDataFrame([(n, t) for n, texts in notices.NOTICES.items() for t in texts], "notice string, text string")
    return notices.find_notices(extracts(spark, sf), templates).withColumnRenamed("extract_id", "doc_id")


# -- Mixing -------------------------------------------------------------------

#: Shares of tokens; the first domain keeps what it has.
MIX = {"good": 0.88, "poor": 0.06, "toxic": 0.06}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("extract_id"), domain.alias("domain"))


@query("op6_mixing_rates")
def op6(spark, sf):
    mixed = mixing.mix_extracts(extracts(spark, sf), domain_labels(spark, sf), MIX, max_rate=math.inf)
    p = [F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(MIX)]
    return mixed.select(F.col("extract_id").alias("doc_id"), "tokens", *p, "rate", "copies")


# -- Fill in the middle -------------------------------------------------------

def _hex_number(i: int) -> str:
    """The i-th 8-digit group of the hex digest `h` as a number."""
    return f"cast('0x' || h[{8 * i + 1}:{8 * i + 8}] as bigint)"


@query("op12_fill_middle", rf"""
    with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || doc_id) as h from documents),
         k as (select *, len(u) as n, {_hex_number(0)} % (len(u) + 1) as a, {_hex_number(1)} % (len(u) + 1) as b,
                      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or {_hex_number(2)} % 100 >= 100 then 'plain'
                           when {_hex_number(3)} % 100 < 50 then 'spm' else 'psm' end as form from d),
         p as (select *, array_to_string(u[1:least(a, b)], '') as pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as mid,
                      array_to_string(u[greatest(a, b) + 1:], '') as suf from k)
    select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
           sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
           sha256(t) as restored_sha256 from p""")
def op12(spark, sf):
    cut = fill_middle.restore_texts(fill_middle.fill_middle(extracts(spark, sf)))
    return cut.select(F.col("extract_id").alias("doc_id"), F.col("n_lines").alias("n"), "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


# -- Periodic runs ------------------------------------------------------------

def with_planted_runs(texts: DataFrame) -> DataFrame:
    """Every tenth text by the CRC-32 of its id becomes periodic from one of its words on."""
    space = F.array_remove(F.split(F.coalesce("text", F.lit("")), quality_rules.SPACE), "")
    # A null id draws like the id `null`.
    h = F.crc32(F.coalesce(F.col("extract_id").cast("string"), F.lit("null")))
    words = texts.select("extract_id", "text", F.when(h % 10 == 0, space).alias("_w"), F.floor(h / 10).alias("_g"))
    start = words.select("*", F.size("_w").alias("_n"), F.when(F.size("_w") > 0, F.col("_g") % F.size("_w")).cast("int").alias("_a"))
    period = start.select("*", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int").alias("_p"))
    at = lambda w, i: F.get("_w", F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i))
    return period.select("extract_id", F.when(F.col("_n") > 0, F.array_join(F.transform("_w", at), " ")).otherwise(F.col("text")).alias("text"))


#: Window widths of the SQL below; a period of over 32,768 words would take a wider one.
_WIDTHS = [8 << k for k in range(13)]


def _runs_sql() -> str:
    """Maximal runs by plain SQL: a window at least as long as the period occurs next exactly one period later, all along a run."""
    bits = "list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    names, found = [], []
    for k, g in enumerate([1, 2, 4, *_WIDTHS]):
        if g > 1:
            names.append(f"n{g} as (select doc_id, i, dense_rank() over (order by x.c, y.c) as c from n{g // 2} x join (select doc_id, i - {g // 2} as i, c from n{g // 2}) y using (doc_id, i))")
        if g >= 8:
            low = 0 if g == 8 else g // 2
            found.append(f"select doc_id, {g} as g, i, d from (select doc_id, i, lead(i) over (partition by doc_id, c order by i) - i as d from n{g}) q where d > {low} and d <= {g}")
    return rf"""
    with b as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as w, list_transform(string_split(cast(doc_id as varchar), ''), lambda s: ascii(s)) as ds from documents),
         h as (select doc_id, w, len(w) as n, xor(4294967295, list_reduce(list_prepend(4294967295, ds), lambda a, b: {bits})) as h from b),
         a as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, (h // 10) % 8 as e from h),
         t as (select doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[case when i >= a then a + (i - a) % (1 + (n - a) // (3 + e)) else i end + 1]) end as w from a),
         u as (select doc_id, unnest(w) as word, unnest(range(n)) as i from t),
         n1 as (select doc_id, i, dense_rank() over (order by word) as c from u), {', '.join(names)},
         s as ({' union all '.join(found)}),
         o as (select doc_id, g, d, i, i - row_number() over (partition by doc_id, g, d order by i) as island from s),
         r as (select doc_id, d as q, min(i) as lo, max(i) + any_value(g) + d as hi from o group by doc_id, g, d, island),
         m as (select * from r where hi - lo >= greatest(24, 3 * q)),
         e as (select doc_id, unnest(range(lo + q, hi)) as i from m),
         k as (select u.doc_id, string_agg(word, ' ' order by u.i) as kept from u anti join e on e.doc_id = u.doc_id and e.i = u.i group by 1),
         c as (select doc_id, count(*) as n_runs, string_agg(lo || ',' || (hi - lo) || ',' || q || chr(10), '' order by lo, q) as runs,
                      min(struct_pack(x := -(hi - lo)::double / q, s := lo, p := q, l := hi - lo)) as best from m group by 1)
    select t.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.p as period, 1000 * best.l // best.p as exponent_milli,
           sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
    from t left join c using (doc_id) left join k using (doc_id)"""


@query("op13_periodic_runs", _runs_sql())
def op13(spark, sf):
    found = periodic_runs.collapse_runs(with_planted_runs(extracts(spark, sf)))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"].cast("double") / r["period"]).alias("x"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (found.select("*", best.alias("_b"), lines.alias("_lines"))
            .select(F.col("extract_id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "_b.start", "_b.length", "_b.period",
                    F.floor(F.col("_b.length") * 1000 / F.col("_b.period")).alias("exponent_milli"), F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")))


# -- Toxicity -----------------------------------------------------------------

@query("op11_toxicity")
def op11(spark, sf):
    fold = lambda c: F.crc32(F.col(c).cast("string")) % 5
    learnt = read(spark, sf, "labels").filter(fold("doc_id") != 0).select(F.col("doc_id").alias("extract_id"), "toxic")
    scored = toxicity.score_extracts(extracts(spark, sf), learnt)
    return scored.select(F.col("extract_id").alias("doc_id"), F.coalesce(fold("extract_id") == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
