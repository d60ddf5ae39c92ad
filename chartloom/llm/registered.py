"""The training-data operators as registered queries, each over its whole table with production parameters."""

from pyspark.sql import functions as F

from chartloom.llm import ann, bpe, compression, dartminhash, langid, lexical, line_dedup, packing, quality, sharding, spelling, training_order, wrappers
from chartloom.llm.tables import new_folder, read

#: Key of the training order.
ORDER_KEY = 20_240_601

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def tokenizer_file() -> str:
    """Vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_harmonic_packing")
def harmonic_packing(spark, sf):
    pieces = packing.pack(read(spark, sf, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_cotraining_quality")
def cotraining_quality(spark, sf):
    docs = read(spark, sf, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf, "labels")))


@query("op3_pruned_graph_neighbours")
def pruned_graph_neighbours(spark, sf):
    return ann.nearest(read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_training_order")
def training_order_records(spark, sf):
    # The shards are written, and the records are what a run that starts at slot 0 reads from them.
    folder = new_folder(spark, "training-order")
    training_order.write_shards(training_order.training_shards(read(spark, sf, "documents"), tokenizer_file(), ORDER_KEY), folder)
    records = training_order.read_from(spark, folder, ordered=False)
    return records.select("doc_id", "piece", "slot", "shard", "position", "length", F.crc32("tokens").alias("tokens_crc32"))


@query(
    "op5_line_dedup",
    """with docs as (select doc_id, text, string_split(coalesce(text,''), chr(10)) as ls from documents),
    lines as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as line_no from docs),
    real as (select doc_id, line_no, line, string_split(line,' ') as w from lines where trim(line,' ')<>''),
    firsts as (select line, any_value(w) as w, min({'d':doc_id,'n':line_no}) as place from real group by line),
    long as (select * from firsts where len(w)>=8),
    cut as (select line, place, len(w) as n, unnest(range(1,len(w)+1)) as i, w from long),
    keys as (select line, place, n, i, array_to_string(list_concat(list_slice(w,1,i-1), list_slice(w,i+1,n)),' ') as k, 0 as side from cut
        union all select line, place, n-1, 0, array_to_string(list_concat(list_slice(w,1,i-1), list_slice(w,i+1,n)),' '), 1 from cut
        union all select line, place, len(w), 0, line, 2 from long),
    sides as (select n, i, k, min(place) as first, min(case when side=1 then place end) as longer, min(case when side=2 then place end) as whole from keys group by 1,2,3),
    near as (select distinct line from keys join sides using (n,i,k) where case side when 0 then first when 1 then whole else longer end < place),
    fate as (select r.doc_id, r.line_no, (f.place<{'d':r.doc_id,'n':r.line_no} or n.line is not null) as gone from real r join firsts f using (line) left join near n using (line)),
    gone as (select doc_id, list(line_no) as g from fate where gone group by 1)
    select d.doc_id, case when g is null then text else array_to_string([ls[j+1] for j in range(len(ls)) if not list_contains(g, j)], chr(10)) end as text,
        len(ls)::bigint as n_lines, coalesce(len(g),0)::bigint as n_dropped from docs d left join gone using (doc_id)""",
)
def dedup_lines(spark, sf):
    return line_dedup.dedup_lines(read(spark, sf, "documents").select("doc_id", "text"))


@query("op6_dart_minhash")
def dart_minhash(spark, sf):
    return dartminhash.near_duplicates(read(spark, sf, "documents"))


@query("op7_differencing_shards")
def differencing_shards(spark, sf):
    return sharding.shard_documents(read(spark, sf, "documents"))


@query("op8_rank_array_bpe")
def rank_array_bpe(spark, sf):
    path = tokenizer_file()
    encoded = bpe.encode_documents(read(spark, sf, "documents"), path)
    decoded = bpe.decode_documents(encoded, path, keep=("doc_id", "ids"))
    return decoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_output_code_language")
def output_code_language(spark, sf):
    docs = read(spark, sf, "documents")
    return langid.identify(docs, langid.fit(docs))


@query("op10_compression_bands")
def compression_bands(spark, sf):
    docs = read(spark, sf, "documents")
    return compression.compression_rules(docs, compression.fit(docs, read(spark, sf, "labels")))


@query(
    "op11_dual_tree_search",
    r"""with low as (select doc_id, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') as t, row_number() over () as r from documents),
    terms as (select doc_id, r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from low),
    tf as (select doc_id, r, w, count(*) as tf from terms group by all),
    docs as (select r, sum(tf)::bigint as n from tf group by 1),
    total as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from docs),
    weights as (select w, floor(1000*ln((2*big_n+2)/(2*count(*)+1)))::bigint as weight from tf, total group by w, big_n),
    asked as (select distinct item_id, unnest(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark),
    scored as (select item_id, doc_id, r, sum(weight*((1000000000*tf)//(1000*tf+8*(10+(90*n*big_n)//big_l))))::bigint as score
        from asked join weights using (w) join tf using (w) join docs using (r), total group by 1,2,3),
    ranked as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scored where score>0)
    select item_id, rank, doc_id, score from ranked where rank<=10""",
)
def dual_tree_search(spark, sf):
    return lexical.rank_documents(read(spark, sf, "benchmark"), read(spark, sf, "documents"))


@query("op12_wrapper_induction")
def wrapper_induction(spark, sf):
    return wrappers.extract_text(read(spark, sf, "pages"))


@query(
    "op13_gram_spelling",
    """with recursive runs as (select doc_id, unnest(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) as w from documents),
    counted as (select coalesce(doc_id::varchar,'') as d, w, count(*) as c from runs where length(w)>=6 group by 1,2),
    poly as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]::bigint[]), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as tbl),
    bytes as (select d, w, c, flatten(list_transform(string_split(d || ':' || w, ''), lambda x: case when unicode(x)<128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint-64] end)) as b from counted),
    hashed as (select w, c, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda x, y: xor(x >> 8, tbl[(xor(x, y) & 255) + 1])), 4294967295::bigint) as h from bytes, poly),
    typed as (select case when h % 199 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, c from hashed),
    words as materialized (select word, sum(c)::bigint as n from typed where length(word)>=6 group by 1 having sum(c)>=5),
    cut as materialized (select word, n, i, left(word, i-1) || substr(word, i+1) as k from words, unnest(range(1, length(word)+1)) as u(i)),
    pairs as (select a.word, b.word as near, b.n as near_n from cut a join cut b on a.i=b.i and a.k=b.k and a.word<>b.word
        union select a.word, b.word, b.n from cut a join words b on a.k=b.word union select b.word, a.word, a.n from cut a join words b on a.k=b.word),
    best as (select word, count(*)::bigint as n_near, min({'less': -near_n, 'near': near}) as b from pairs group by 1),
    forms as materialized (select w.word, w.n, coalesce(n_near,0)::bigint as n_near, case when -b.less >= 5*w.n then b.near end as form, case when -b.less >= 5*w.n then (-b.less)::bigint end as form_n from words w left join best using (word)),
    steps as (select word, word as root from forms union all select s.word, f.form from steps s join forms f on f.word = s.root where f.form is not null)
    select f.word, f.form, s.root, f.n, f.n_near, f.form_n from forms f join steps s using (word) join forms l on l.word = s.root where l.form is null""",
)
def gram_spelling(spark, sf):
    return spelling.spelling_groups(read(spark, sf, "documents"))
