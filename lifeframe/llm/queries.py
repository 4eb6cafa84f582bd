"""The operators as queries over the given tables, with SQL for the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeframe.llm import bpe, decontaminate, langid, lattice, lines, merkle, quality, ring, secret_scan, simhash, trie, urls, warc

QUERIES, ORACLES = {}, {}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(
    "op9_line_dedup",
    f"""
    with l as (
        select doc_id, i, line,
               translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as k
        from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i
              from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))
    ), r as (
        select k, max(doc_id) as last from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3
    )
    select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
    from (select l.*, r.k is not null as gone from l left join r on l.k = r.k and l.doc_id < r.last)
    group by doc_id
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), n_lines="n_lines", n_dropped="n_dropped")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.linked(table(spark, folder, "documents"))
    return found.selectExpr("id as doc_id", "lower(lpad(hex(print), 16, '0')) as fingerprint", "component as component_id")


@query("op6_byte_level_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], digests=True)


@query("op4_decontamination")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.selectExpr("doc as doc_id", "item as item_id", "edits", "end as end_word")


@query("op10_ring_sharding")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    placed = ring.shard_documents(table(spark, folder, "documents"), 40)
    return placed.selectExpr("doc_id", "size", "text_crc32", "'rows' as law", "shard", "slot", "cast(null as int) as grown_shard")


# The rules of the query.
URL_RULES = (
    urls.HostRule("allow", "com", "/"),
    urls.HostRule("block", "example.com", "/en/"),
    urls.HostRule("allow", "www.example.com", "/en/"),
    urls.HostRule("block", "net", "/es/"),
    urls.HostRule("block", "net", "/fr/"),
)
# The default globs as regular expressions over host and path.
_GLOBS_SQL = (
    r"(^|^[^/]*\.)spam[^/]*(/|$)", r"^[^/]*casino[^/]*/", r"(^|^[^/]*\.)ads\.[^/]*/", r"(^|^[^/]*\.)doubleclick\.[^/]*/",
    r"/wp-login\.php$", r"/cgi-bin/", r"/login/", r"\.exe$", r"\.zip$",
)


@query(
    "op7_url_filters",
    f"""
    with r(verdict, rhost, rpath) as (values {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
    u as (
        select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages
    ), p as (
        select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
        from u
    ), m as (
        select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
        from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
        group by page_id
    )
    select p.page_id, host, path, rule,
           coalesce(verdict, case when {" or ".join(f"regexp_matches(host || path, '{g}', 's')" for g in _GLOBS_SQL)} then 'block' else 'allow' end)
               as verdict
    from p left join m using (page_id)
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = urls.judge(table(spark, folder, "pages"), URL_RULES)
    return found.selectExpr("id as page_id", "host", "path", "rule", "verdict")


@query(
    "op8_warc",
    """
    with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as n from pages),
    f as (select payload_digest, min(page_id) as first from p where n >= 100 group by payload_digest)
    select page_id, n as payload_bytes, p.payload_digest,
           case when page_id <> first then 'revisit' else 'response' end as record_type,
           case when page_id <> first then first end as refers_to
    from p left join f using (payload_digest)
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


@query("op2_secret_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = secret_scan.scan(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.selectExpr("id as doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.filter(~held_out), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return langid.predict(docs, model, extra={"held_out": held_out}).withColumnRenamed("id", "doc_id")


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """All nodes of trees given by their leaves (tree, i, n, node)."""
    return f"""{name} as (
        select tree, 0 as k, i, n, node from {leaves}
        union all
        select tree, k + 1, i // 8, (n + 7) // 8, sha256(string_agg(node, '' order by i)) from {name} where n > 1 group by tree, k, i // 8, n
    )"""


def _siblings_sql(tree: str, base: int) -> str:
    run = "over (partition by tree, k, i // 8 order by i rows between"
    return f"""select tree, {base} + k as step, k, i,
            coalesce(string_agg(node, '') {run} unbounded preceding and 1 preceding), '') as before,
            coalesce(string_agg(node, '') {run} 1 following and unbounded following), '') as after
        from {tree} where n > 1"""


# A checksum bit by bit, as there is no function for it.
_CRC32_SQL = """xor(list_reduce(list_transform(string_split({0}::varchar, ''), lambda c: ascii(c)::bigint), lambda crc, c:
    list_reduce([0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end), xor(crc, c)), 4294967295::bigint), 4294967295)"""


@query(
    "op11_merkle_manifest",
    f"""
    with recursive d as (
        select doc_id, lang, {_leaf_sql("text")} as leaf,
               case when {_CRC32_SQL.format("doc_id")} % 3 = 0 then {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} end as tampered
        from documents
    ), langs as (
        select lang, n, row_number() over (order by lang nulls first) - 1 as tree from (select lang, count(*) as n from d group by lang)
    ), p as (
        select doc_id, leaf, coalesce(tampered, leaf) as later, tree, n, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i
        from d join langs on d.lang is not distinct from langs.lang
    ), leaves as (select tree, i, n, leaf as node from p),
    {_tree_sql("low", "leaves")},
    subroots as (select tree, node from low where n = 1),
    tops as (select 0 as tree, tree as i, (select count(*) from langs) as n, node from subroots),
    {_tree_sql("high", "tops")},
    sib as (
        {_siblings_sql("low", 0)} union all
        {_siblings_sql("high", 1000)}
    ), steps as (
        select p.tree, p.i, step, before, after from p join sib on step < 1000 and sib.tree = p.tree and sib.i = p.i // pow(8, k)::bigint
        union all
        select p.tree, p.i, step, before, after from p join sib on step >= 1000 and sib.i = p.tree // pow(8, k)::bigint
    ), proofs as (
        select tree, i, string_agg(before || after, '' order by step) as proof, list(before || '|' || after order by step) as path from steps group by tree, i
    ), folded as (
        select p.*, sha256(coalesce(proof, '')) as proof_sha256,
               list_reduce(coalesce(path, []::varchar[]), lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2)), later) as folded_root
        from p left join proofs using (tree, i)
    )
    select doc_id, leaf, s.node as subroot, r.node as root, proof_sha256, folded_root, folded_root = r.node as verified
    from folded join subroots s using (tree) cross join (select node from high where n = 1) r
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.manifest(docs, tampered={"text": merkle.lowered(F.col("text"))}, where=tampered)
    return found.withColumnRenamed("id", "doc_id")


@query(
    "op12_embedding_near_dedup",
    """
    with recursive v as (
        select vec_id, label, embedding::double[] as e from embeddings
        where label is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
          and list_bool_and(list_transform(embedding, lambda x: isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))
    ), l as (
        select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
        where case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= 0.98 else false end
    ), r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
    c as (select a, min(b) as b from r group by a), n as (select a, count(*) as n from l group by a)
    select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(b, vec_id)) as component_id, vec_id <= coalesce(b, vec_id) as kept
    from embeddings left join c on c.a = vec_id left join n on n.a = vec_id
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = lattice.near_vectors(table(spark, folder, "embeddings"))
    return found.withColumnsRenamed({"id": "vec_id", "component": "component_id"})


@query(
    "op13_conversation_trie",
    f"""
    with t as (
        select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
               row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
        from conversations where conv_id is not null
    ), c as (select conv_id, {_CRC32_SQL.format("conv_id")} % 9 as h, conv_id - conv_id % 5 as base from (select distinct conv_id from t)),
    own as (
        select c.conv_id, 0 as part, pos, role, text from c join t on t.conv_id = c.base and pos < h
        union all
        select c.conv_id, 1, pos, role, text from c join t using (conv_id) where pos >= h
    ), s as (select conv_id, list(sha256(strlen(role) || ':' || role || text) order by part, pos) as turns, list(strlen(text) order by part, pos) as bytes from own group by conv_id),
    every as (select conv_id, coalesce(turns, []) as turns, coalesce(bytes, []) as bytes from c left join s using (conv_id)),
    p as (
        select conv_id, d as depth, array_to_string(turns[:d], ',') as node, array_to_string(turns[:d - 1], ',') as parent, bytes[d] as bytes, len(turns) = d as last
        from (select *, unnest(range(0, len(turns) + 1)) as d from every)
    ), n as (
        select depth, node, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, coalesce(any_value(bytes), 0) as bytes,
               sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '')) as ends_sha256
        from p group by depth, node
    ), k as (select n.*, (select count(*) from n m where m.parent = n.node and m.depth = n.depth + 1) as n_children from n)
    select a.conv_id, a.depth, b.conv_id as parent_conv_id, a.n_convs, a.n_children, f.n_leaves, f.saved_tokens, a.ends_sha256
    from k a left join n b on b.node = a.parent and b.depth = a.depth - 1
    join (select x.depth, x.node, count(*) filter (where y.n_children = 0) as n_leaves, sum((y.n_convs - 1) * y.bytes)::bigint as saved_tokens
          from k x join k y on y.depth = x.depth and y.node = x.node or y.depth > x.depth and (x.depth = 0 or starts_with(y.node, x.node || ','))
          group by x.depth, x.node) f on f.depth = a.depth and f.node = a.node
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return trie.trie(*trie.rebuild(trie.turns(table(spark, folder, "conversations"))))
