"""The text operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.llm import ann, bpe, decontaminate, divergence, exact, language, licence, lines, mixing, near, negatives, quality, urls

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Shares of the blocks; a source that isn't named has OTHER_SHARE.
SHARES = {"src0": 6, "src1": 4, "src2": 4, "src3": 3}
OTHER_SHARE, BLOCK_ROWS = 2, 64

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, vocabulary).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.scanned(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classified(docs.select("doc_id", "text", "source", "lang"), labels, whole=False).select("doc_id", F.col("_p").alias("evidence"), F.col("_site").alias("site_rate"), F.col("_quality").alias("quality"), (F.col("_quality") >= quality.THRESHOLD).alias("kept"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "pages"), language.train(table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    placed = mixing.mixed(docs, SHARES, OTHER_SHARE, BLOCK_ROWS)
    return placed.select("doc_id", "source", *[F.col(f"_{c}").cast("long").alias(c) for c in ("block", "cycle", "slot", "rank")])


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.searched(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked): pages that a fixed rule decides, by it, and other pages whose path has the number
    of a labelled document, which is the page's text: blocked if it is bad or toxic."""
    known = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("_bad"))
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/([0-9]{1,18})", 1)
    numbered = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id"), urls.by_rules(F.col("url"), URL_RULES).alias("_fixed"))
    both = numbered.join(known, "doc_id", "left").select("url", F.coalesce("_fixed", "_bad").alias("blocked"))
    return both.where("blocked is not null")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, urls.mine(labelled_urls(pages, table(spark, sf_dir, "labels"))), URL_RULES)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of any length but empty ones."""
    cleaned = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has its label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_licence, op3_quality, op4_language, op5_mixing, op6_nearest, op7_exact_dedup, op8_urls, op9_near_dedup, op10_lines, op11_negatives, op12_decontamination, op13_divergence)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TEMPLATES = ", ".join(
    f"('{' '.join(w[i : i + licence.GRAM])}', {n}, {i}, {len(w) - licence.GRAM + 1}, {n < len(licence.PHRASES)}, '{label}')"
    for n, (text, label) in enumerate([*licence.PHRASES.items(), *licence.NOTICES.items()])
    for w in [text.split()]
    for i in range(len(w) - licence.GRAM + 1)
)

ORACLE_SQL: dict[str, str] = {
    "op2_licence": rf"""
        with w as (select row_number() over () as row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        g as (select row, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] as gram from (select row, w, unnest(range(0, len(w) - 2)) as pos from w)),
        t(gram, template, spot, grams, exact, label) as (values {TEMPLATES}),
        voted as (
            select row, template, grams, exact, label, pos - spot as diagonal, list(distinct spot) as spots, min(pos) as lo, max(pos) as hi
            from g join t using (gram) group by all),
        merged as (
            select row, template, grams, exact, label, diagonal,
                (case when exact then len(spots) else len(list_distinct(flatten(list(spots) over beside))) end) / grams as cover,
                case when exact then lo else min(lo) over beside end as lo, (case when exact then hi else max(hi) over beside end) + 2 as hi
            from voted window beside as (partition by row, template order by diagonal range between current row and {licence.SLACK} following)),
        valued as (select *, [cover, grams, -template, -diagonal]::double[] as value from merged),
        good as (
            select * from valued v where case when exact then cover = 1 else cover >= {licence.COVER} and not exists (
                select 1 from valued o where o.row = v.row and not o.exact and o.lo <= v.hi and o.hi >= v.lo and o.value > v.value) end)
        select doc_id, len(any_value(w)) as n_words, count(*) filter (exact) as n_base, min(lo) filter (exact) as first_word, max(lo) filter (exact) as last_word,
            coalesce(string_agg(distinct label, ',' order by label) filter (exact), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label), '') as labels, coalesce(max(cover), 0.0::double) as score
        from w left join good using (row) group by row, doc_id""",
    "op9_near_dedup": rf"""
        with recursive d as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from d),
        n as (select doc_id, count(*) as n from s group by 1),
        pairs as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (s) where x.doc_id < y.doc_id group by 1, 2),
        links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        reach as (select distinct doc_id, doc_id as r from d union select reach.doc_id, case when r = a then b else a end from reach join links on r in (a, b)),
        component as (select doc_id, min(r) as component_id from reach group by 1)
        select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from d left join n using (doc_id) join component using (doc_id)""",
    "op7_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
        g as (select *, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from d)
        select doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) as kept, sha256(t) as text_sha256 from g""",
    "op5_mixing": f"""
        with recursive s as (
            select coalesce(source, '') as source, count(*) as n,
                cast(case coalesce(source, '') {' '.join(f"when '{k}' then {v}" for k, v in SHARES.items())} else {OTHER_SHARE} end as bigint) as q
            from documents group by 1),
        total as (select cast(sum(q) as bigint) as d from s),
        jobs as (
            select source, j, (j * d) // q as release, ((j + 1) * d + q - 1) // q as deadline, q, d
            from s, total, (select unnest(range(0, (select max(q) from s))) as j) where j < q),
        ranked_jobs as (select *, row_number() over (order by deadline, source) as pri from jobs),
        edf as (
            select cast(0 as bigint) as t, [cast(-1 as bigint)] as done
            union all
            select t + 1, list_append(done, (select min(pri) from ranked_jobs r where r.release <= t and not list_contains(done, r.pri)))
            from edf where t < (select d from total)),
        picks as (select done from edf where t = (select d from total)),
        slots as (select p.pri, p.slot from (select unnest(done[2:]) as pri, unnest(range(0, len(done) - 1)) as slot from picks) p),
        turns as (select r.source, r.j as turn, slots.slot, r.q from slots join ranked_jobs r using (pri)),
        ranked as (
            select doc_id, source, coalesce(source, '') as s,
                row_number() over (partition by coalesce(source, '') order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 as rank
            from documents)
        select ranked.doc_id, ranked.source, cast(rank // {BLOCK_ROWS} as bigint) as block, cast((rank // {BLOCK_ROWS}) // turns.q as bigint) as cycle,
            cast(turns.slot as bigint) as slot, cast(rank as bigint) as rank
        from ranked join turns on turns.source = ranked.s and turns.turn = (rank // {BLOCK_ROWS}) % turns.q""",
    "op11_negatives": """
        with e as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
            from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
        positive as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from scored where same),
        negative as (
            select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
                row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
            from positive p join scored n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score where p.place <= 5)
        select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from negative where rank <= 5""",
    "op12_decontamination": rf"""
        with d as (select row_number() over () as row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        i as (select *, least(len(w), {decontaminate.SIZE}) as size from b where len(w) > 0),
        g as (select distinct item, size, unnest(list_transform(range(0, len(w) - size + 1), lambda p: array_to_string(w[p + 1:p + size], ' '))) as gram from i),
        t as (select row, size, unnest(range(0, len(w) - size + 1)) as pos, w from d, (select distinct size from g) where len(w) >= size),
        h as (select row, pos, size, item from (select row, pos, size, array_to_string(w[pos + 1:pos + size], ' ') as gram from t) join g using (size, gram)),
        words as (select row, count(*) as n from (select distinct row, pos + unnest(range(0, size)) as at from h) group by 1),
        named as (select row, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct row, item from h) group by 1)
        select doc_id, len(w) as n_words, coalesce(words.n, 0) as n_hit, coalesce(named.n, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
        from d left join words using (row) left join named using (row)""",
    "op13_divergence": rf"""
        with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        o as (select row, lang, source, unnest(w) as term from d),
        kept as (select lang, term from o group by all having count(distinct row) >= {divergence.LEAST_DOCUMENTS}),
        size as (select lang, count(*) as v from kept group by 1),
        c as (select lang, source, term, count(*) as n from o join kept using (lang, term) group by all),
        parts as (select lang, source, false as whole from d group by 1, 2 union all select lang, '', true from d group by 1),
        full_c as (
            select p.lang, p.source, p.whole, k.term, coalesce(sum(n), 0) as n
            from parts p join kept k using (lang) left join c on c.lang = p.lang and c.term = k.term and (p.whole or c.source = p.source) group by all),
        shares as (
            select f.*, v, 1 + cast(1000000000 * (n::hugeint + 5) // (sum(n) over (partition by lang, source, whole)::hugeint + 5 * v) as bigint) as p from full_c f join size using (lang)),
        pairs as (
            select x.lang, x.source, y.source as item, coalesce(sum(abs(a.p - b.p)), 0) as value
            from parts x join parts y on x.lang = y.lang and x.source <> y.source and not x.whole and not y.whole
            left join shares a on a.lang = x.lang and a.source = x.source and not a.whole left join shares b on b.lang = y.lang and b.source = y.source and not b.whole and b.term = a.term group by all),
        over as (
            select a.lang, a.source, a.term as item, a.p - b.p as value
            from shares a join shares b on a.lang = b.lang and a.term = b.term and not a.whole and b.whole where a.n > 0 and a.p > b.p),
        made as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from over),
        ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from made)
        select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= {divergence.TOP_TERMS}""",
}
