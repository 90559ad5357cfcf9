"""The corpus operators' queries over whole tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import cut, scratch_path, table
from quillsift.llm.decontaminate import contamination_report
from quillsift.llm.embedding_dedup import embedding_links
from quillsift.llm.langid import held_out, identify, learn
from quillsift.llm.licenses import TEMPLATES, THRESHOLD, license_matches, template_bigrams
from quillsift.llm.line_dedup import dedup_lines
from quillsift.llm.mixing import mix_sources
from quillsift.llm.ngram_join import jaccard_groups
from quillsift.llm.substring_dedup import dedup_substrings
from quillsift.llm.token_rollup import TokenRollup, counted_each, deleted, inserted, of_version, revised
from quillsift.llm.warc import page_records


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"), 0.9)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents"), counts=True)
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_substrings(table(spark, sf_dir, "documents"), window=50)
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), entropy_share=0.95, max_repeats=4.0)
    return mixed.select("doc_id", "source", "mix_weight", "mix_pass", "mix_block", "mix_rank")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs, ~held_out("doc_id"))
    return identify(docs, profiles).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are inserted; those labelled toxic are deleted, in a batch that is sent twice; the others labelled of low quality are counted anew by another tokenizer."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    low = labels.where("quality = 0").select(F.col("doc_id").alias("id")).distinct().join(toxic, "id", "left_anti")
    counts = cut(counted_each(docs, {"blank-1": None, "alnum-1": None}), "counts")
    gone, anew = counts.join(toxic, "id", "left_semi"), counts.join(low, "id", "left_semi")
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("0001-insert", inserted(of_version(counts, "blank-1")))
    for _ in range(2):
        rollup.commit("0002-delete", deleted(of_version(gone, "blank-1")))
    rollup.commit("0003-revise", revised(of_version(anew, "blank-1"), of_version(anew, "alnum-1")))
    rollup.compact()
    return rollup.totals()


def op9_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_embedding_neardup, op3_decontamination, op4_line_dedup, op5_substring_dedup, op6_source_mixing, op7_language_id, op8_token_rollup, op9_warc_records, op10_license_scan)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[^\x20\x09-\x0D]+'"
_CLOSE = """
near(a, b) AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_BLANK}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM w)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN z x ON a = x.doc_id JOIN z y ON b = y.doc_id WHERE 100 * m >= 90 * (x.n + y.n - m)),
nodes AS (SELECT doc_id AS id FROM documents), {_CLOSE}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN z USING (doc_id) JOIN comp ON id = doc_id
"""

OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings), {_CLOSE},
deg AS (SELECT a, count(*) AS n FROM near GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON id = vec_id LEFT JOIN deg ON a = vec_id
"""

_NORM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_NORM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_NORM}) AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT doc_id, i, x.k, item_id FROM (SELECT doc_id, i, y.k, array_to_string(w[i:i + y.k - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN (SELECT DISTINCT k FROM k) y WHERE i + y.k - 1 <= len(w)) x JOIN k ON k.g = x.g AND k.k = x.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP4 = r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(13)) AS norm FROM
  (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE length(text) > 0))),
w AS (SELECT doc_id, i, [norm, lead(norm) OVER o, lead(norm, 2) OVER o] AS g, lead(norm, 2) OVER o AS last FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM w WHERE last IS NOT NULL AND array_to_string(g, '') <> ''),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (VALUES (0), (1), (2)) v(j) WHERE r > 1),
k AS (SELECT l.doc_id, count(*) AS n, count(gone.i) AS m, string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS src FROM s GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM s JOIN m USING (g) WHERE src < doc_id),
p AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT p.doc_id, count(gone.i) AS n, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

OP8 = rf"""
WITH toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
c AS (SELECT source, lang, CASE WHEN doc_id IN (FROM low) THEN 'alnum-1' ELSE 'blank-1' END AS tokenizer,
  CASE WHEN doc_id IN (FROM low) THEN len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) ELSE len(regexp_extract_all(text, {_BLANK})) END AS n
  FROM documents WHERE doc_id NOT IN (FROM toxic))
SELECT source, lang, tokenizer, count(*) AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_tokens FROM c GROUP BY 1, 2, 3
"""

OP9 = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to FROM f
"""


def _license_sql() -> str:
    known = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{b}'" for b in template_bigrams(text))) for name, texts in TEMPLATES.items() for text in texts)
    p, q = THRESHOLD.numerator, THRESHOLD.denominator
    return rf"""
WITH u AS (SELECT doc_id, i, us[i] AS unit FROM (SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS i FROM
  (SELECT doc_id, list_concat(string_split(text, chr(10)), list_filter(string_split_regex(text, '\n[ \t\r]*\n'), lambda x: contains(x, chr(10)))) AS us FROM documents))),
w AS (SELECT doc_id, i, string_split(trim(regexp_replace({_LOWER.format("unit")}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
a AS (SELECT doc_id, i, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) ELSE w END AS a FROM w WHERE w[1] <> ''),
t(license, t) AS (VALUES {known}),
x AS (SELECT doc_id, i, license, len(list_intersect(a, t)) AS m, len(a) + len(t) AS n FROM a JOIN t ON len(a) * {p} <= len(t) * {2 * q - p} AND len(t) * {p} <= len(a) * {2 * q - p}),
y AS (SELECT doc_id, i, license, max(2.0::DOUBLE * m / n) AS dice FROM x WHERE m * {2 * q} >= n * {p} GROUP BY 1, 2, 3)
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units FROM y GROUP BY 1, 2
"""


SQL = {"op1_ngram_jaccard_join": OP1, "op2_embedding_neardup": OP2, "op3_decontamination": OP3, "op4_line_dedup": OP4, "op5_substring_dedup": OP5, "op8_token_rollup": OP8, "op9_warc_records": OP9, "op10_license_scan": _license_sql()}
