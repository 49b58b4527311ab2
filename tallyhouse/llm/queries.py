"""The queries of this subpackage: thin digests over the operators, on whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, countjoin, decontaminate, imatch, langid, licenses, lines, minhash, pii, prefixtrie, sharding, substrings, variants

#: The public tokenizer file that op2 encodes with.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, sf_dir), 16).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), TOKENIZER)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(_documents(spark, sf_dir)))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_documents(spark, sf_dir))


def op5_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_passages(_documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edits(_documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op11_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countjoin.join_near(_documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = variants.count_words(_documents(spark, sf_dir), slips=True)
    return variants.group_variants(counted.where(F.col("n") >= variants.LEAST_COUNT))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), share=True).drop("start", "end")


QUERIES = {"op1_sharding": op1_sharding, "op2_bpe": op2_bpe, "op3_decontamination": op3_decontamination, "op4_pii": op4_pii, "op5_licenses": op5_licenses, "op5_license_passages": op5_license_passages, "op6_line_dedup": op6_line_dedup, "op7_substring_dedup": op7_substring_dedup, "op8_language_id": op8_language_id, "op9_imatch": op9_imatch, "op10_minhash": op10_minhash, "op11_count_vector_join": op11_count_vector_join, "op12_spelling_variants": op12_spelling_variants, "op13_prefix_trie": op13_prefix_trie}


def _licenses_sql() -> str:
    """The licence scan in SQL; templates become a table of bigram lists."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, licenses.bigrams(text)))}])" for name, text in sorted(licenses.TEMPLATES.items()))
    return f"""
with t(template, b) as (values {rows}),
c as (select doc_id, string_split(regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) l from documents where text is not null),
u as (select doc_id, unnest(range(len(l)))::int as line, unnest(l) unit from c union all select doc_id, -1, array_to_string(l, ' ') from c where len(l) > 1),
w as (select doc_id, line, list_filter(string_split(trim(unit), ' '), lambda x: x <> '') w from u),
g as (select doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g from w where len(w) > 1),
d as (select doc_id, line, template, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) dice from g join t on len(g) between len(b) * {licenses.THRESHOLD} / (2 - {licenses.THRESHOLD}) - 1e-9 and len(b) * (2 - {licenses.THRESHOLD}) / {licenses.THRESHOLD} + 1e-9)
select doc_id, line, string_split(template, '#')[1] license, template, round(dice, 6) dice from d where dice >= {licenses.THRESHOLD} qualify row_number() over (partition by doc_id, line order by dice desc, template) = 1"""


_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _components_sql(percent: int, kept: str) -> str:
    """Components of documents by the Jaccard similarity of their sets of 5-word shingles."""
    return f"""
with recursive d as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from d, unnest(range(1, greatest(len(w) - 3, 2))) r(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by 1),
pairs as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
sym as (select a, b from links union select b as a, a as b from links),
reach as (select doc_id, doc_id root from d union select r.doc_id, sym.b from reach r join sym on r.root = sym.a)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, component_id{kept} from d left join n using (doc_id) join (select doc_id, min(root) component_id from reach group by 1) using (doc_id)"""


def _crc32_sql(codes: str) -> str:
    """CRC-32 of a list of byte values, bit by bit."""
    fold = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {fold}), 4294967295)"


def _variants_sql() -> str:
    """Words, slips, neighbours by deletion, forms and roots."""
    crc = _crc32_sql("list_transform(range(octet_length(encode(s))), lambda k: ('0x' || substr(hex(encode(s)), (2 * k + 1)::int, 2))::bigint)")
    return f"""
with r as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) w from documents),
g as (select doc_id, w, count(*) n, coalesce(doc_id::varchar, '') || ':' || w s from r group by all),
c as (select w, n, {crc} h from g),
f as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end w, n from c),
d as (select w as word, sum(n)::bigint n from f where length(w) >= 6 group by 1 having sum(n) >= 5),
x as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) less from d, unnest(range(length(word))) q(i)),
p as (select a.word, b.word other from x a join x b on a.less = b.less and a.i = b.i and a.word <> b.word union select x.word, d.word from x join d on d.word = x.less union select d.word, x.word from x join d on d.word = x.less),
o as (select p.word, p.other, d.n other_n from p join d on d.word = p.other),
q as (select word, count(*) n_near, first(other order by other_n desc, other collate "C") best, max(other_n) best_n from o group by 1),
y as (select d.word, d.n, coalesce(n_near, 0) n_near, case when best_n >= 5 * d.n then best end form, case when best_n >= 5 * d.n then best_n end form_n from d left join q using (word)),
z as (select * from (with recursive s as (select word, word root, form from y union all select s.word, y.word, y.form from s join y on y.word = s.form) select word, root from s where form is null))
select y.word, form, root, n, n_near, form_n from y join z using (word)"""


def _trie_sql() -> str:
    """Rebuilt conversations as lists of turns, their prefixes as nodes, and subtrees by expanding each node to its ancestors."""
    crc = _crc32_sql("list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::bigint)")
    return f"""
with t as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) pos from conversations where conv_id is not null),
n as (select conv_id, count(*) n, any_value(conv_id::varchar) s from t group by 1),
h as (select n.conv_id, n.conv_id - n.conv_id % 5 base, {crc} % 9 h from n),
b as (select h.*, least(h, coalesce(n.n, 0)) taken from h left join n on n.conv_id = base),
u as (select t.conv_id, taken + pos - h as pos, r, x from t join b using (conv_id) where pos > h union all select b.conv_id, t.pos, r, x from b join t on t.conv_id = b.base where t.pos <= h),
l as (select n.conv_id, coalesce(list({{'r': r, 'x': x}} order by pos) filter (where pos is not null), []) l from n left join u using (conv_id) group by 1),
m as (select conv_id, l[1:d] as path, d, l[1:d - 1] as up, l[d].x as x from l, unnest(range(len(l) + 1)) q(d)),
v as (select path, d, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * coalesce(strlen(any_value(x)), 0) saving, any_value(up) as up from m group by 1, 2),
k as (select up as path, count(*) n_children from v where d > 0 group by 1),
a as (select v.path[1:j] as path, sum((n_children is null)::int) n_leaves, sum(saving) saved from v left join k on k.path = v.path, unnest(range(d + 1)) q(j) group by 1),
e as (select l as path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) ends from l group by 1)
select v.conv_id, v.d as depth, case when v.d > 0 then p.conv_id end parent_conv_id, v.n_convs, coalesce(n_children, 0) n_children, n_leaves::bigint n_leaves, saved::bigint saved_tokens, coalesce(ends, sha256('')) ends_sha256
from v join a on a.path = v.path left join k on k.path = v.path left join e on e.path = v.path left join v p on p.path = v.up and v.d > 0"""


ORACLE_SQL: dict[str, str] = {
    "op5_licenses": _licenses_sql(),
    "op7_substring_dedup": f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
s as (select doc_id, i, array_to_string(w[i:i + 34], ' ') seq from d, unnest(range(1, len(w) - 33)) r(i)),
twice as (select seq from s group by 1 having count(*) > 1),
gone as (select distinct doc_id, i + k as place from s semi join twice using (seq), unnest(range(35)) q(k)),
g as (select doc_id, list(place) gone from gone group by 1),
k as (select d.doc_id, len(w) n, array_to_string(case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]) end, ' ') kept, coalesce(len(gone), 0) n_removed from d left join g using (doc_id))
select doc_id, n n_words, n_removed, sha256(kept) kept_sha256 from k""",
    "op10_minhash": _components_sql(75, ", d.doc_id = component_id kept"),
    "op11_count_vector_join": _components_sql(80, ""),
    "op12_spelling_variants": _variants_sql(),
    "op13_prefix_trie": _trie_sql(),
}
