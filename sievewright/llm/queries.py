"""Registered queries of the operators in this folder, and their SQL statements for DuckDB."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import egojoin, hardneg, idfiles, imatch, katz, langid, lexsearch, minhash, mix, pieces, pii, shard, warc
from sievewright.llm.following import with_next

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The folder of the public vocabularies is a parameter: a package that knows it, or a path.
PIECES = "piece_bpe_32k.model"
WORD_TOKENS = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffled(*columns: str) -> list[Column]:
    """A reproducible order without regard to content."""
    return [F.xxhash64(F.lit("mix"), *columns), *[F.col(c) for c in columns]]


@query("op1_mix")
def op1_mix(spark, sf_dir):
    """All documents mixed: sources to the power 0.7 of their size, in blocks of eight rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix.mix_sources(docs, shuffled("doc_id")).select("position", "doc_id", "source", "pass")


@query("op2_shard")
def op2_shard(spark, sf_dir):
    """Shard and slot of every document; the law is `rows`: counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return shard.shard_rows(keys, order, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_pii")
def op7_pii(spark, sf_dir):
    """Personal data in every document: base counts and digest, and all spans."""
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["rank"] < len(pii.BASE))
    count = {k: F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as long)") for k in pii.BASE}
    return found.select(
        "doc_id", *[n.alias(f"n_{k}") for k, n in count.items()],
        F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined("pii").alias("spans"),
    )


@query("op10_imatch")
def op10_imatch(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and how alike they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = imatch.lexicon(docs)
    own = imatch.with_fingerprint(docs, words, "text", "fingerprint").withColumn("hash", F.xxhash64("text"))
    both = with_next(own, "doc_id", "hash", ["text", "fingerprint"])
    half = "length(text) div 2"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))")
    rows = both.select(
        "doc_id", "fingerprint", "next_fingerprint", F.length("text").cast("long").alias("n_chars"),
        edited.alias("edited"),
    )
    done = imatch.with_fingerprint(rows, words, "edited", "edited_fingerprint")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        imatch.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        imatch.likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


NEAR_SQL = r"""with recursive docs as (
        select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda v: v <> '') as w from documents),
    parts as materialized (select doc_id, unnest(list_distinct(case when len(w) >= 5
            then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as part from docs),
    sizes as materialized (select doc_id, count(*) as n from parts group by 1),
    common as (select x.doc_id as a, y.doc_id as b, count(*) as c from parts x join parts y on x.part = y.part
            where x.doc_id < y.doc_id group by 1, 2),
    links as materialized (select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b
            where 100 * c >= 75 * (p.n + q.n - c)),
    sides as materialized (select a, b from links union select b, a from links),
    reach as (select doc_id as node, doc_id as seen from documents
            union select reach.node, sides.b from reach join sides on reach.seen = sides.a),
    least as (select node, min(seen) as component_id from reach group by 1)
    select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
    from documents d join least on node = d.doc_id left join sizes s on s.doc_id = d.doc_id"""


@query("op4_minhash", NEAR_SQL)
def op4_minhash(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_langid")
def op5_langid(spark, sf_dir):
    """Language of every document; a third of the documents is held out of training."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.filter("not held_out"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


VECTOR_SQL = """with recursive v as materialized (select vec_id, label, embedding::double[] as e from embeddings
            where label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as materialized (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label
            and x.vec_id <> y.vec_id and len(x.e) = len(y.e)
            where list_cosine_similarity(x.e, y.e) >= 0.93),
    reach as (select vec_id as node, vec_id as seen from embeddings
            union select reach.node, links.b from reach join links on reach.seen = links.a),
    least as (select node, min(seen) as component_id from reach group by 1),
    sums as (select a, count(*) as n from links group by 1)
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
    from embeddings join least on node = vec_id left join sums on a = vec_id"""


@query("op8_egojoin", VECTOR_SQL)
def op8_egojoin(spark, sf_dir):
    """Links and components of all embeddings with equal labels."""
    return egojoin.similar_vectors(table(spark, sf_dir, "embeddings"))


@query(
    "op6_warc",
    """with p as (select page_id, coalesce(html, '') as h from pages),
            d as (select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest from p),
            f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as m from d)
       select page_id, payload_bytes, payload_digest,
              case when m <> page_id then 'revisit' else 'response' end as record_type,
              case when m <> page_id then m end as refers_to from f""",
)
def op6_warc(spark, sf_dir):
    """All pages written as web archives and fetched again through the capture index."""
    pages = table(spark, sf_dir, "pages")
    back = warc.write_archive(pages).fetch(pages.select("url"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_pieces")
def op9_pieces(spark, sf_dir):
    """Every document encoded into pieces and decoded again."""
    vocabulary = pieces.load(vocabulary_path(PIECES))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, vocabulary, keep=["doc_id"])
    back = pieces.decode(coded, vocabulary, keep=["doc_id", "ids"])
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.length("decoded").cast("long").alias("decoded_chars"),
    )


def crc_of_ids(ids) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


@query("op3_idcoder")
def op3_idcoder(spark, sf_dir):
    """Token ids of every document written as range-coded files, and read from them."""
    with open(vocabulary_path(WORD_TOKENS)) as source:
        definition = source.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = idfiles.write_ids(docs, definition)
    return files.read(crc_of_ids, "ids_crc32 long").withColumnRenamed("key", "doc_id")


RANKS_SQL = r"""with words as materialized (select doc_id, unnest(regexp_extract_all(translate(text,
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
    asked as materialized (select item_id, unnest(regexp_extract_all(translate(text,
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
    lengths as materialized (select doc_id, count(*)::bigint as n from words group by 1),
    totals as (select count(*)::bigint as docs, sum(n)::bigint as len from lengths),
    held as materialized (select term, doc_id, count(*)::bigint as tf from words
            where term in (select term from asked) group by 1, 2),
    weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w
            from held, totals group by term, docs),
    norms as (select doc_id, 25 + (75 * n * docs) // len as m from lengths, totals),
    scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
            from asked join weights using (term) join held using (term) join norms using (doc_id) group by 1, 2),
    ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
            from scores where score > 0)
    select * from ranked where rank <= 10"""


@query("op11_lexsearch", RANKS_SQL)
def op11_lexsearch(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    index = lexsearch.build_index(table(spark, sf_dir, "documents"), for_items=items)
    return lexsearch.search(index, items)


KATZ_SQL = r"""with keyed as materialized (select doc_id, coalesce(text, '') as text, coalesce(xor(4294967295, list_reduce(
            [4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
            lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 7 = 2, false) as held_out
            from documents),
    lists as (select doc_id, held_out, [' start'] || list_filter(regexp_split_to_array(translate(text,
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') || [' end'] as l from keyed),
    pairs as materialized (select doc_id, held_out, l[i] as v, l[i + 1] as w from (select *, unnest(range(1, len(l))) as i from lists)),
    one as materialized (select w, count(*) as c from pairs where not held_out group by 1),
    two as materialized (select v, w, count(*) as c from pairs where not held_out group by 1, 2),
    sizes as (select 1 as kind, c, count(*) as n from one group by 2 union all select 2, c, count(*) from two group by 2),
    filled as materialized (select kind, list(n order by r) as n from (select k.kind, r, coalesce(sum(s.n), 0)::double as n
            from (values (1), (2)) k(kind) cross join range(1, 7) t(r) left join sizes s on s.kind = k.kind and s.c = r group by 1, 2) group by 1),
    tried as materialized (select kind, k, r, n, (k + 1) * n[k + 1] / nullif(n[1], 0) as last,
            ((r + 1) * n[r + 1] / nullif(r * n[r], 0) - (k + 1) * n[k + 1] / nullif(n[1], 0))
              / nullif(1 - (k + 1) * n[k + 1] / nullif(n[1], 0), 0) as d
            from filled, range(2, 6) a(k), range(1, 6) b(r) where r <= k),
    fit as (select kind, k from tried group by 1, 2 having bool_and(coalesce(last < 1 and d > 0 and d < 1 and n[k + 1] > 0, false))),
    ratios as materialized (select kind, r, d from tried where (kind, k) in (select (kind, max(k)) from fit group by kind)),
    totals as (select coalesce(sum(c), 0)::bigint as total, count(*) as types,
            coalesce(sum(c), 0)::bigint + (select count(*) = 0 from ratios where kind = 1)::int as whole from one),
    chance as materialized (select w, c, coalesce(d, 1) * c / whole as p from totals, one left join ratios on kind = 1 and r = c),
    unseen as (select 1 - coalesce(sum(p), 0) as p from chance),
    context as materialized (select v, sum(c) + (sum(c) > 65536 or not bool_or(r is not null))::int as total
            from two left join ratios on kind = 2 and r = c group by 1),
    follow as materialized (select v, two.w, coalesce(d, 1) * two.c / total as p, chance.p as p1 from two join context using (v)
            join chance on chance.w = two.w left join ratios on kind = 2 and r = two.c),
    weight as materialized (select v, (1 - sum(p)) / (1 - sum(p1)) as a from follow group by 1)
    select doc_id, held_out, count(*) as n_tokens, count(chance.c) as n_known, total as train_tokens,
           round(sum(log10((coalesce(chance.c, 0) + 1) / (total + types + 1))), 6) as base_score,
           round(sum(log10(coalesce(follow.p, coalesce(a, 1) * coalesce(chance.p, unseen.p)))), 6) as score
    from totals, unseen, pairs left join follow on follow.v = pairs.v and follow.w = pairs.w left join weight on weight.v = pairs.v
    left join chance on chance.w = pairs.w group by doc_id, held_out, total"""


@query("op12_katz", KATZ_SQL)
def op12_katz(spark, sf_dir):
    """Base score and log10 probability of every text; a seventh of the documents is held out of training."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = katz.train(docs.filter(~held_out))
    scored = katz.log_probabilities(docs, model, [F.col("doc_id"), held_out.alias("held_out")])
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


NEGATIVES_SQL = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as materialized (select x.vec_id as a, y.vec_id as b, x.label = y.label as same,
            list_inner_product(x.e, y.e)::bigint as score
            from v x join v y on x.vec_id % 100 = 0 and x.vec_id <> y.vec_id and len(x.e) = len(y.e)),
    p as materialized (select a, b, score from s where same
            qualify row_number() over (partition by a order by score desc, b) <= 5)
    select p.a as anchor_id, p.b as positive_id,
            row_number() over (partition by p.a, p.b order by s.score desc, s.b)::int as rank, s.b as negative_id,
            p.score as positive_score, s.score as negative_score
    from p join s on p.a = s.a and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
    qualify row_number() over (partition by p.a, p.b order by s.score desc, s.b) <= 10"""


@query("op13_hardneg", NEGATIVES_SQL)
def op13_hardneg(spark, sf_dir):
    """Hard negatives of every hundredth vector; the labels of every seventh are moved by one."""
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), label)
