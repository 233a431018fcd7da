"""Registered queries and their DuckDB oracles.

Queries run over the specification view of ``documents`` (see sources.corpus) unless they name another table. Oracles are written
on their own, in DuckDB's dialect: no look-around, ASCII word boundaries, sentences split through a marker character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicon as lx
from .functions import text as tx
from .functions import udfs
from .operators import compare, consensus, extract, linkage, quality, reports
from .plans import facade
from .session import kept, ready
from .sources import files
from .sources.corpus import corpus, corpus_sql

QUERIES: dict = {}
ORACLES: dict = {}

PAGE = ("spec", "version")


def query(name: str, sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ready(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def side(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """(spec, page_number, text) of one version."""
    return corpus(spark, sf_dir).filter(F.col("version") == version).select("spec", "page_number", "text")


# Oracle building blocks -----------------------------------------------------------------------------------------------

CORPUS = f"WITH corpus AS ({corpus_sql()})"
LINES = (
    CORPUS
    + """, raw_lines AS (
  SELECT spec, version, page_number, unnest(string_split(text, chr(10))) AS l, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS pos FROM corpus),
lines AS (SELECT spec, version, page_number, pos, trim(regexp_replace(l, '^\\s+|\\s+$', '', 'g')) AS line FROM raw_lines)"""
)
SENTENCES = (
    CORPUS
    + """, squashed AS (SELECT spec, version, page_number, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([a-z])([A-Z])', '\\1 \\2', 'g') AS t FROM corpus),
parts AS (SELECT spec, version, page_number, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM squashed),
sentences AS (SELECT spec, version, page_number, unnest(s) AS text, CAST(unnest(range(len(s))) AS INT) AS pos FROM parts)"""
)


def sql_any(words: list[str], x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def sql_category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(w, f'lower({x})')} THEN '{k}'" for k, w in lx.CATEGORIES.items()) + " ELSE 'Functional' END"


def sql_phrases(words: list[str], x: str) -> str:
    return f"regexp_matches({x}, '(?i)\\b(" + "|".join(words) + ")\\b')"


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g'))"


def sql_norm(x: str) -> str:
    return f"lower({sql_clean(x)})"


def sql_hash(x: str) -> str:
    return f"substring(sha1({sql_norm(x)}), 1, 12)"


HEADING = "line <> '' AND NOT starts_with(lower(line), 'chapter') AND NOT regexp_matches(line, '\\.{3,}\\s*\\d+$') AND NOT regexp_matches(line, '^\\d+$') AND regexp_matches(line, '^(\\d+(?:\\.\\d+)*|[A-C]\\d+(?:\\.\\d+)*)\\s+(.+)$') AND length(trim(regexp_extract(line, '^(\\d+(?:\\.\\d+)*|[A-C]\\d+(?:\\.\\d+)*)\\s+(.+)$', 2))) >= 3"
HEADINGS = LINES + f""", headings AS (
  SELECT spec, version, page_number, pos, regexp_extract(line, '^(\\d+(?:\\.\\d+)*|[A-C]\\d+(?:\\.\\d+)*)\\s+(.+)$', 1) AS section_id,
         trim(regexp_extract(line, '^(\\d+(?:\\.\\d+)*|[A-C]\\d+(?:\\.\\d+)*)\\s+(.+)$', 2)) AS title FROM lines WHERE {HEADING})"""
SECTIONS = HEADINGS + """, own AS (SELECT spec, version, page_number, arg_max(section_id, pos) AS own FROM headings GROUP BY ALL),
page_section AS (SELECT c.spec, c.version, c.page_number, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY c.spec, c.version ORDER BY c.page_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Unknown') AS section
  FROM corpus c LEFT JOIN own o USING (spec, version, page_number))"""
REQUIREMENTS = SENTENCES + f", requirements AS (SELECT spec, version, page_number, pos, {sql_category('text')} AS category, text FROM sentences WHERE {sql_phrases(lx.REQUIREMENT_PHRASES, 'text')})"


# Extraction -----------------------------------------------------------------------------------------------------------


@query("req_by_category", REQUIREMENTS + " SELECT spec, version, category, count(*) AS n FROM requirements GROUP BY ALL")
def _(spark, d):
    return extract.requirements(corpus(spark, d)).groupBy("spec", "version", "category").agg(F.count(F.lit(1)).alias("n"))


@query("requirements", REQUIREMENTS + " SELECT * FROM requirements")
def _(spark, d):
    return extract.requirements(corpus(spark, d))


@query("headings", HEADINGS + " SELECT spec, version, page_number, pos, section_id, title FROM headings")
def _(spark, d):
    return extract.headings(corpus(spark, d)).drop("font_size")


@query("first_headings", LINES + r""", hits AS (SELECT *, row_number() OVER (PARTITION BY spec, version, page_number ORDER BY pos) AS n FROM lines
  WHERE pos < 80 AND line <> '' AND NOT starts_with(lower(line), 'chapter') AND NOT regexp_matches(line, '\.{3,}\s*\d+$') AND NOT regexp_matches(line, '^\d+$')
    AND regexp_matches(line, '^(\d+(?:\.\d+)*|[A-C]\d+(?:\.\d+)*)\.?\s+(.+)$') AND length(trim(regexp_extract(line, '^(\d+(?:\.\d+)*|[A-C]\d+(?:\.\d+)*)\.?\s+(.+)$', 2))) >= 3
    AND regexp_matches(regexp_extract(line, '^(\d+(?:\.\d+)*|[A-C]\d+(?:\.\d+)*)\.?\s+(.+)$', 1), '^([A-C]\d+(?:\.\d+)*|\d+(?:\.\d+)+)$'))
SELECT spec, version, page_number, regexp_extract(line, '^(\d+(?:\.\d+)*|[A-C]\d+(?:\.\d+)*)\.?\s+(.+)$', 1) AS section_id, trim(regexp_extract(line, '^(\d+(?:\.\d+)*|[A-C]\d+(?:\.\d+)*)\.?\s+(.+)$', 2)) AS title FROM hits WHERE n = 1""")
def _(spark, d):
    return extract.first_heading(corpus(spark, d))


@query("sections_tree", HEADINGS + r" SELECT spec, version, page_number, pos, section_id AS id, title, CASE WHEN contains(section_id, '.') THEN regexp_replace(section_id, '\.[^.]*$', '') END AS parent FROM headings")
def _(spark, d):
    return extract.section_tree(extract.headings(corpus(spark, d)))


@query("page_section", SECTIONS + " SELECT * FROM page_section")
def _(spark, d):
    return extract.page_sections(corpus(spark, d))


@query("semantic_chunks", HEADINGS + """, own AS (SELECT spec, version, page_number, arg_max(section_id, pos) AS own FROM headings GROUP BY ALL),
marked AS (SELECT c.*, own, CAST(sum(CASE WHEN own IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY spec, version ORDER BY page_number) AS BIGINT) AS chunk FROM corpus c LEFT JOIN own USING (spec, version, page_number))
SELECT spec, version, chunk, max(own) AS section, CAST(count(*) AS BIGINT) AS n_pages, min(page_number) AS first_page, max(page_number) AS last_page, CAST(length(regexp_replace(string_agg(text, chr(10) ORDER BY page_number), '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS n_chars
FROM marked WHERE chunk > 0 GROUP BY spec, version, chunk""")
def _(spark, d):
    c = extract.semantic_chunks(corpus(spark, d))
    return c.select(*PAGE, "chunk", "section", F.size("pages").cast("bigint").alias("n_pages"), F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"), F.length("text").cast("bigint").alias("n_chars"))


@query("notes", LINES + r" SELECT spec, version, page_number, pos, trim(split_part(upper(line), ':', 1)) AS type, line AS text FROM lines WHERE regexp_matches(line, '(?i)^(NOTE|WARNING|CAUTION|IMPORTANT|ASSUMPTION)\b')")
def _(spark, d):
    return extract.notes(corpus(spark, d))


STOP = "[" + ", ".join(f"'{w}'" for w in lx.ACRONYM_STOPLIST) + "]"
APART = "' ' || regexp_replace(text, '[^\\pL\\pN_]', '  ', 'g') || ' '"


@query("acronyms", CORPUS + f" SELECT DISTINCT spec, version, acronym FROM (SELECT spec, version, unnest(regexp_extract_all({APART}, ' ([A-Z]{{2,10}}) ', 1)) AS acronym FROM corpus) WHERE NOT list_contains({STOP}, acronym)")
def _(spark, d):
    return extract.acronyms(corpus(spark, d))


@query("signals", CORPUS + f" SELECT DISTINCT spec, version, page_number, signal FROM (SELECT spec, version, page_number, unnest(regexp_extract_all({APART}, ' ([A-Z][A-Z0-9_]{{2,}}) ', 1)) AS signal FROM corpus)")
def _(spark, d):
    return extract.signals(corpus(spark, d))


@query("cross_refs", CORPUS + r""", refs AS (SELECT spec, version, page_number,
  list_concat(list_concat(list_transform(regexp_extract_all(text, '(?i)Section\s+\d+(?:\.\d+)*'), lambda r: {'kind': 'section', 'ref': r}), list_transform(regexp_extract_all(text, '(?i)Figure\s+[A-Za-z]?\d+(?:[-.]\d+)*'), lambda r: {'kind': 'figure', 'ref': r})),
              list_transform(regexp_extract_all(text, '(?i)Table\s+[A-Za-z]?\d+(?:[-.]\d+)*'), lambda r: {'kind': 'table', 'ref': r})) AS x FROM corpus),
each AS (SELECT spec, version, page_number, unnest(x) AS r, CAST(unnest(range(len(x))) AS INT) AS pos FROM refs) SELECT spec, version, page_number, pos, r.kind AS kind, r.ref AS ref FROM each""")
def _(spark, d):
    return extract.cross_references(corpus(spark, d))


CAPTIONS = LINES + r", captions AS (SELECT spec, version, page_number, pos, line AS caption FROM lines WHERE regexp_matches(line, '(?i)^Table\s+[A-Za-z]?\d+(?:[-.]\d+)*[:.]?\s*.*$'))"


@query("table_captions", CAPTIONS + " SELECT * FROM captions")
def _(spark, d):
    return extract.table_captions(corpus(spark, d))


@query("expected_captions", CAPTIONS + " SELECT spec, version, concat(CAST(page_number AS VARCHAR), ':', lower(trim(regexp_replace(caption, '\\s+', ' ', 'g')))) AS key, count(*) AS n FROM captions GROUP BY ALL")
def _(spark, d):
    return extract.expected_captions(corpus(spark, d), lx.TABLE_CAPTION)


@query("figures")
def _(spark, d):
    return extract.figures(corpus(spark, d))


@query("encoding_rules")
def _(spark, d):
    """Codes of the parts table, written as an encoding table of each brand."""
    part = spark.read.parquet(f"{d}/part.parquet")
    row = F.concat(F.lit("0b"), F.lpad(F.bin("p_size"), 6, "0"), F.lit(" OP"), F.col("p_size").cast("string"), F.lit(" The manager must set "), F.col("p_type"))
    pages = part.groupBy(F.col("p_brand").alias("spec"), F.lit(1).alias("version"), (F.col("p_partkey") % 7).cast("int").alias("page_number")).agg(F.array_join(F.array_sort(F.collect_set(row)), " ").alias("text"))
    return extract.encoding_rules(pages)


@query("specification_sentences")
def _(spark, d):
    return extract.specification_sentences(corpus(spark, d))


@query("req_dedup_ids", REQUIREMENTS + SECTIONS.removeprefix(CORPUS) + r""", first AS (SELECT *, row_number() OVER (PARTITION BY spec, version, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY page_number, pos) AS n FROM requirements),
placed AS (SELECT f.spec, f.version, f.page_number, f.pos, f.text, s.section, CASE WHEN trim(regexp_replace(s.section, '[^A-Za-z0-9]+', '_', 'g'), '_') = '' THEN 'UNKNOWN' ELSE trim(regexp_replace(s.section, '[^A-Za-z0-9]+', '_', 'g'), '_') END AS slug FROM first f JOIN page_section s USING (spec, version, page_number) WHERE n = 1)
SELECT spec, version, page_number, pos, section, text, printf('REQ_%s_%03d', slug, row_number() OVER (PARTITION BY spec, version, slug ORDER BY page_number, pos)) AS id FROM placed""")
def _(spark, d):
    pages = corpus(spark, d)
    found = extract.first_occurrences(extract.requirements(pages)).join(extract.page_sections(pages), [*PAGE, "page_number"])
    return extract.with_ids(found).drop("category")


@query("vplan_relevant", SENTENCES + r" SELECT spec, version, page_number, pos, text FROM sentences WHERE NOT regexp_matches(text, '(?i)\b(?:Figure|Fig\.?)\s+[A-Za-z]?\d+(?:\.\d+)*') AND NOT regexp_matches(text, '(?i)^(?:In Figure|As shown in Figure|The figure shows|This assertion indicates|In this case|For example)\b') AND " + sql_phrases(lx.SPECIFICATION_PHRASES, "text"))
def _(spark, d):
    return corpus(spark, d).select(*PAGE, "page_number", F.posexplode(tx.sentences("text")).alias("pos", "text")).filter(tx.is_relevant("text"))


@query("vplan_filter", HEADINGS + r""", ok AS (SELECT *, regexp_matches(section_id, '^[A-C]\d+(?:\.\d+)*$') AS ok FROM headings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY spec, version, ok ORDER BY page_number, pos) AS n, row_number() OVER (PARTITION BY spec, version ORDER BY page_number, pos) AS place, max(CAST(ok AS INT)) OVER (PARTITION BY spec, version) AS anyok FROM ok)
SELECT spec, version, section_id AS section, substring(title, 1, 80) AS content FROM ranked WHERE (anyok = 1 AND ok AND n <= 5) OR (anyok = 0 AND place <= 3)""")
def _(spark, d):
    return facade.plan_filter(extract.section_tree(extract.headings(corpus(spark, d))))


def _sql_scored(x: str) -> str:
    rows = []
    for k, w in lx.CATEGORIES.items():
        hits = " + ".join(f"CAST(contains(lower({x}), '{v}') AS INT)" for v in w)
        if k == "Protocol":
            hits += f" + CASE WHEN regexp_matches({x}, '{lx.AXI_SIGNAL}') THEN 2 ELSE 0 END"
        if k == "Architecture":
            hits += f" + CASE WHEN regexp_matches({x}, '{lx.RISCV_CSR}') THEN 2 ELSE 0 END"
        rows.append(f"{{'hits': {hits}, 'prio': {-lx.PRIORITY.index(k)}, 'name': '{k}'}}")
    return f"list_max([{', '.join(rows)}])"


@query("req_scored_category", REQUIREMENTS + f", s AS (SELECT *, {_sql_scored('text')} AS top FROM requirements) SELECT spec, version, page_number, pos, CASE WHEN top.hits > 0 THEN top.name ELSE 'Functional' END AS scored FROM s")
def _(spark, d):
    return extract.requirements(corpus(spark, d)).select(*PAGE, "page_number", "pos", tx.scored_category("text").alias("scored"))


@query("req_short_category", REQUIREMENTS + " SELECT CASE " + " ".join(f"WHEN {sql_any(w, 'lower(text)')} THEN '{k}'" for k, w in lx.SHORT_CATEGORIES.items()) + " ELSE 'Functional' END AS category, count(*) AS n FROM requirements GROUP BY ALL")
def _(spark, d):
    return extract.requirements(corpus(spark, d)).groupBy(tx.category("text", lx.SHORT_CATEGORIES).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("chunk_pages", HEADINGS + " SELECT DISTINCT c.spec, c.version, c.page_number AS page FROM corpus c JOIN (SELECT spec, version, min(page_number) AS f FROM headings GROUP BY ALL) USING (spec, version) WHERE c.page_number >= f")
def _(spark, d):
    return files.chunk_pages(extract.semantic_chunks(corpus(spark, d)))


@query("visual_hints", "SELECT doc_id, list_transform(list_filter(" + str(sorted(lx.VISUAL_HINTS)) + ", lambda w: contains(lower(text), w)), lambda w: upper(w)) AS hints FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.visual_hints("text", F.lit("")).alias("hints"))


@query("page_accuracy", CORPUS + ", n AS (SELECT spec, max(page_number) AS n FROM corpus WHERE version = 1 GROUP BY spec), h AS (SELECT c.spec, count(DISTINCT page_number) AS have FROM corpus c JOIN n USING (spec) WHERE version = 2 AND page_number BETWEEN 1 AND n GROUP BY c.spec) SELECT n.spec, round(100.0::DOUBLE * coalesce(have, 0) / n, 6) AS share FROM n LEFT JOIN h USING (spec)")
def _(spark, d):
    total = side(spark, d, 1).groupBy("spec").agg(F.max("page_number").alias("n"))
    return quality.page_accuracy(total, side(spark, d, 2))


@query("token_counts", CORPUS + f" SELECT spec, version, upper(m) AS key, count(*) AS n FROM (SELECT spec, version, unnest(regexp_extract_all(text, '{lx.AXI_SIGNAL}')) AS m FROM corpus) GROUP BY ALL")
def _(spark, d):
    return extract.token_counts(corpus(spark, d), lx.AXI_SIGNAL)


@query("score_labels", "SELECT doc_id, CASE WHEN v >= 90 THEN 'Excellent' WHEN v >= 75 THEN 'Good' WHEN v >= 60 THEN 'Fair' ELSE 'Poor' END AS label, CASE WHEN v >= 95 THEN 'pass' ELSE 'fail' END AS status, printf('%.0f%%', round_even(v / 800 * 100, 0)) AS share FROM (SELECT doc_id, CAST(doc_id % 101 AS DOUBLE) AS v FROM documents)")
def _(spark, d):
    labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("doc_id") % 101).cast("double").alias("v"))
    return labels.select("doc_id", tx.score_label("v").alias("label"), tx.status("v").alias("status"), tx.percent_text(F.col("v") / 800).alias("share"))


# Text functions -------------------------------------------------------------------------------------------------------


@query("norm_hash", f"SELECT doc_id, {sql_hash('text')} AS hash, CAST(length({sql_norm('text')}) AS BIGINT) AS n FROM documents")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", tx.stable_hash("text").alias("hash"), F.length(tx.normalised("text")).cast("bigint").alias("n"))


NUMBERS = r"regexp_extract_all(c, '(?i)[-+]?\d+(?:\.\d+)?(?:\s*(?:%|v|a|hz|khz|mhz|ghz|ms|us|ns|s|kb|mb|gb|bit|bits|byte|bytes))?')"


@query("numbers_words_refs", CORPUS + f", t AS (SELECT spec, version, page_number, {sql_clean('text')} AS c FROM corpus) SELECT spec, version, page_number, list_transform({NUMBERS}, lambda x: lower({sql_clean('x')})) AS numbers, list_transform(regexp_extract_all(c, '(?i)\\b(shall|must|will|should|required to|may not|is prohibited|may|can)\\b', 1), lambda x: lower(x)) AS words, list_transform(regexp_extract_all(c, '(?i)\\b(?:section|figure|fig\\.?|table)\\s+[A-Za-z]?\\d+(?:[-.]\\d+)*'), lambda x: lower({sql_clean('x')})) AS refs FROM t")
def _(spark, d):
    return corpus(spark, d).select(*PAGE, "page_number", tx.numbers("text").alias("numbers"), tx.strength_words("text").alias("words"), tx.references("text").alias("refs"))


TOKEN_STOP = "[" + ", ".join(f"'{w}'" for w in lx.COMMON_TOKENS) + "]"


def sql_tokens(source: str, keys: str, text: str) -> str:
    """Tables of source's tokens: tok (keys, tokens in the order of first occurrence)."""
    return f""", each_token AS (SELECT {keys}, unnest(m) AS token, unnest(range(len(m))) AS place FROM (SELECT {keys}, regexp_extract_all(lower({text}), '[a-z0-9_]+') AS m FROM {source})),
firsts AS (SELECT {keys}, token, min(place) AS place FROM each_token WHERE length(token) >= 3 AND NOT list_contains({TOKEN_STOP}, token) GROUP BY ALL),
lists AS (SELECT {keys}, list(token ORDER BY place) AS tokens FROM firsts GROUP BY ALL),
tok AS (SELECT s.*, coalesce(l.tokens, []) AS tokens FROM {source} s LEFT JOIN lists l USING ({keys}))"""


@query("significant_tokens", CORPUS + sql_tokens("corpus", "spec, version, page_number", "text") + " SELECT spec, version, page_number, tokens FROM tok")
def _(spark, d):
    return corpus(spark, d).select(*PAGE, "page_number", tx.tokens("text").alias("tokens"))


@query("section_slugs", HEADINGS + r" SELECT DISTINCT title, regexp_replace(regexp_replace(trim(lower(title)), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g') AS slug FROM headings")
def _(spark, d):
    return extract.headings(corpus(spark, d)).select("title", tx.slug("title").alias("slug")).distinct()


@query("human_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.0f B', n) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576) ELSE printf('%.2f GB', n / 1073741824) END AS size FROM (SELECT doc_id, CAST(n_chars * (1 + doc_id % 5000) AS DOUBLE) AS n FROM documents)")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", tx.human_size(F.col("n_chars") * (1 + F.col("doc_id") % 5000)).alias("size"))


@query("previews", f"SELECT doc_id, CASE WHEN length(c) <= 120 THEN c ELSE substring(c, 1, 117) || '...' END AS preview FROM (SELECT doc_id, {sql_clean('text')} AS c FROM documents)")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.preview("text").alias("preview"))


@query("paragraphs")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", udfs.paragraph(F.col("text")).alias("paragraph"))


# Linkage and comparison -----------------------------------------------------------------------------------------------


def page_items(spark: SparkSession, d: str, version: int) -> DataFrame:
    return facade.version_tables(side(spark, d, version))["page"]


PAGES = CORPUS + f""", items AS (SELECT *, CAST(row_number() OVER (PARTITION BY spec, version ORDER BY page_number) - 1 AS INT) AS idx, {sql_norm('text')} AS norm, {sql_hash('text')} AS hash FROM corpus),
numbered AS (SELECT *, row_number() OVER (PARTITION BY spec, version, hash ORDER BY idx) AS n FROM items WHERE norm <> ''),
exact AS (SELECT a.spec, a.hash, a.idx AS old_idx, b.idx AS new_idx, a.page_number AS old_page, b.page_number AS new_page FROM numbered a JOIN numbered b ON a.spec = b.spec AND a.hash = b.hash AND a.n = b.n AND a.version = 1 AND b.version = 2)"""


@query("exact_match", PAGES + " SELECT spec, hash, old_idx, new_idx FROM exact")
def _(spark, d):
    old, new = (linkage.records(page_items(spark, d, v)) for v in (1, 2))
    return linkage.exact_matches(old, new)


@query("keyed_match", PAGES + ", k AS (SELECT spec, version, 'REQ:' || (idx // 2) AS key, max(idx) AS idx FROM items GROUP BY ALL) SELECT a.spec, a.key, a.idx AS old_idx, b.idx AS new_idx FROM k a JOIN k b ON a.spec = b.spec AND a.key = b.key AND a.version = 1 AND b.version = 2")
def _(spark, d):
    old, new = (page_items(spark, d, v).withColumn("key", F.concat(F.lit("REQ:"), F.floor(F.col("idx") / 2).cast("string"))) for v in (1, 2))
    return linkage.keyed_matches(old, new)


@query("moved_items", PAGES + " SELECT spec, hash, old_page, new_page FROM exact WHERE old_page <> new_page")
def _(spark, d):
    old, new = (linkage.records(page_items(spark, d, v)) for v in (1, 2))
    m = linkage.exact_matches(old, new)
    m = m.join(old.select("spec", F.col("idx").alias("old_idx"), F.col("page").alias("old_page")), ["spec", "old_idx"]).join(new.select("spec", F.col("idx").alias("new_idx"), F.col("page").alias("new_page")), ["spec", "new_idx"])
    return m.filter("old_page <> new_page").select("spec", "hash", "old_page", "new_page")


@query("removed_added_exact", PAGES + " SELECT spec, page_number AS page, 'removed' AS change FROM items i WHERE version = 1 AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.spec = i.spec AND e.old_idx = i.idx) UNION ALL SELECT spec, page_number, 'added' FROM items i WHERE version = 2 AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.spec = i.spec AND e.new_idx = i.idx)")
def _(spark, d):
    old, new = (linkage.records(page_items(spark, d, v)) for v in (1, 2))
    m = linkage.exact_matches(old, new)
    gone = linkage.unmatched(old, m, "old").select("spec", "page", F.lit("removed").alias("change"))
    return gone.unionByName(linkage.unmatched(new, m, "new").select("spec", "page", F.lit("added").alias("change")))


@query("page_shift", PAGES + """, each AS (SELECT spec, new_page - old_page AS page_shift, count(*) AS n, min(old_page) AS old_from, max(old_page) AS old_to, min(new_page) AS new_from, max(new_page) AS new_to, min(old_idx) AS seq FROM exact WHERE new_page <> old_page GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY n DESC, seq) AS r FROM each) SELECT spec, page_shift, n, old_from, old_to, new_from, new_to FROM ranked WHERE r = 1 AND n >= 3""")
def _(spark, d):
    old, new = (linkage.records(page_items(spark, d, v)) for v in (1, 2))
    m = linkage.exact_matches(old, new)
    m = m.join(old.select("spec", F.col("idx").alias("old_idx"), F.col("page").alias("old_page")), ["spec", "old_idx"]).join(new.select("spec", F.col("idx").alias("new_idx"), F.col("page").alias("new_page")), ["spec", "new_idx"])
    return compare.page_shifts(m.withColumn("seq", F.col("old_idx")))


CANDIDATES = PAGES + ", filled AS (SELECT spec, version, idx, norm, length(text) AS len FROM items WHERE norm <> '')" + sql_tokens("filled", "spec, version, idx", "norm") + """,
ex AS (SELECT spec, version, idx, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM tok),
pairs AS (SELECT a.spec, a.idx AS old_idx, b.idx AS new_idx, count(*) AS shared, min(a.pos) AS first FROM ex a JOIN ex b ON a.spec = b.spec AND a.token = b.token AND a.version = 1 AND b.version = 2 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY spec, old_idx ORDER BY shared DESC, first, new_idx) AS rank FROM pairs)"""


@query("token_candidates_top20", CANDIDATES + """ SELECT r.spec, r.old_idx, r.new_idx, r.shared, CAST(r.rank AS INT) AS rank FROM ranked r
  JOIN tok a ON a.spec = r.spec AND a.version = 1 AND a.idx = r.old_idx JOIN tok b ON b.spec = r.spec AND b.version = 2 AND b.idx = r.new_idx
  WHERE r.rank <= 20 AND least(a.len, b.len) / greatest(a.len, b.len) >= 0.35 AND len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.08""")
def _(spark, d):
    old, new = (linkage.records(page_items(spark, d, v)) for v in (1, 2))
    return linkage.likely_candidates(old, new, first=None).select("spec", "old_idx", "new_idx", "shared", "rank")


@query("similar_match")
def _(spark, d):
    old, new = (linkage.records(page_items(spark, d, v)) for v in (1, 2))
    m = linkage.exact_matches(old, new)
    return linkage.similar_matches(linkage.unmatched(old, m, "old"), linkage.unmatched(new, m, "new"), lx.THRESHOLDS["page"], near=linkage.NEAR)


def _sections(spark: SparkSession, d: str, v: int) -> DataFrame:
    return facade.version_tables(side(spark, d, v))["section"]


@query("section_diff", HEADINGS + r""", placed AS (SELECT *, row_number() OVER (PARTITION BY spec, version ORDER BY page_number, pos) AS place FROM headings),
keyed AS (SELECT *, row_number() OVER (PARTITION BY spec, version, section_id ORDER BY place) AS n FROM placed),
keys AS (SELECT spec, version, CASE WHEN n > 1 THEN section_id || ':' || place ELSE section_id END AS key, title FROM keyed),
a AS (SELECT * FROM keys WHERE version = 1), b AS (SELECT * FROM keys WHERE version = 2)
SELECT coalesce(a.spec, b.spec) AS spec, coalesce(a.key, b.key) AS key, a.title AS old_title, b.title AS new_title, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'modified' END AS change_type
FROM a FULL JOIN b ON a.spec = b.spec AND a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR lower(a.title) <> lower(b.title)""")
def _(spark, d):
    return compare.section_pairs(_sections(spark, d, 1), _sections(spark, d, 2))


@query("metadata_diff", "WITH m AS (SELECT source AS spec, unnest(['title', 'version', 'author']) AS key, unnest([substring(max(text), 1, 20), '1.' || CAST(max(doc_id) % 3 AS VARCHAR), 'x']) AS a, unnest([substring(max(text), 1, 20), '1.' || CAST(max(doc_id) % 4 AS VARCHAR), 'y']) AS b FROM documents GROUP BY source) SELECT spec, key AS identifier, " + sql_clean("a") + " AS old_value, " + sql_clean("b") + " AS new_value FROM m WHERE key IN ('title', 'version', 'revision') AND " + sql_clean("a") + " <> " + sql_clean("b"))
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").groupBy(F.col("source").alias("spec")).agg(F.max("text").alias("t"), F.max("doc_id").alias("i"))

    def meta(n: int, author: str) -> DataFrame:
        pairs = F.map_from_arrays(F.array(F.lit("title"), F.lit("version"), F.lit("author")), F.array(F.substring("t", 1, 20), F.concat(F.lit("1."), (F.col("i") % n).cast("string")), F.lit(author)))
        return docs.select("spec", F.explode(pairs).alias("key", "value"))

    return compare.metadata_changes(meta(3, "x"), meta(4, "y")).select("spec", "identifier", "old_value", "new_value")


@query("acronym_diff", CORPUS + f", a AS (SELECT DISTINCT spec, version, acronym FROM (SELECT spec, version, unnest(regexp_extract_all({APART}, ' ([A-Z]{{2,10}}) ', 1)) AS acronym FROM corpus) WHERE NOT list_contains({STOP}, acronym)) SELECT spec, acronym, CASE WHEN min(version) = 2 THEN 'added' ELSE 'removed' END AS change_type FROM a GROUP BY spec, acronym HAVING count(*) = 1")
def _(spark, d):
    a, b = (extract.acronyms(side(spark, d, v), ("spec",)) for v in (1, 2))
    return compare.acronym_changes(a, b)


@query("change_categories", PAGES + rf""", met AS (SELECT e.spec, e.old_idx, e.new_idx, a.norm AS a, b.norm AS b FROM (SELECT spec, page_number - 1 AS old_idx, page_number - 1 AS new_idx, page_number FROM items WHERE version = 1) e JOIN items a ON a.spec = e.spec AND a.version = 1 AND a.page_number = e.page_number JOIN items b ON b.spec = e.spec AND b.version = 2 AND b.page_number = e.page_number + 1),
f AS (SELECT spec, old_idx, a, b, {NUMBERS.replace('(c,', '(a,')} AS na, {NUMBERS.replace('(c,', '(b,')} AS nb, regexp_extract_all(a, '(?i)\b(shall|must|will|should|required to|may not|is prohibited|may|can)\b', 1) AS wa, regexp_extract_all(b, '(?i)\b(shall|must|will|should|required to|may not|is prohibited|may|can)\b', 1) AS wb, regexp_extract_all(a, '(?i)\b(?:section|figure|fig\.?|table)\s+[A-Za-z]?\d+(?:[-.]\d+)*') AS ra, regexp_extract_all(b, '(?i)\b(?:section|figure|fig\.?|table)\s+[A-Za-z]?\d+(?:[-.]\d+)*') AS rb FROM met)
SELECT spec, CASE WHEN na <> nb THEN 'numeric_value_change' WHEN wa <> wb THEN 'requirement_strength_change' WHEN ra <> rb THEN 'cross_reference_change' ELSE 'wording' END AS category, count(*) AS n FROM f GROUP BY ALL""")
def _(spark, d):
    a = side(spark, d, 1).select("spec", "page_number", tx.normalised("text").alias("a"))
    b = side(spark, d, 2).select("spec", (F.col("page_number") - 1).alias("page_number"), tx.normalised("text").alias("b"))
    early = F.when(tx.numbers("a") != tx.numbers("b"), "numeric_value_change").when(tx.strength_words("a") != tx.strength_words("b"), "requirement_strength_change").when(tx.references("a") != tx.references("b"), "cross_reference_change").otherwise("wording")
    return a.join(b, ["spec", "page_number"]).groupBy("spec", early.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def exact_changes(spark: SparkSession, d: str) -> DataFrame:
    """Page and note changes by exact matching alone: what summaries can be checked on."""
    pages = QUERIES["removed_added_exact"](spark, d).select("spec", F.lit("page").alias("area"), F.col("change").alias("change_type"), F.concat(F.lit("page_"), "change").alias("difference_category"), F.concat(F.lit("Page "), "page").alias("identifier"), "page")
    moved = QUERIES["moved_items"](spark, d).select("spec", F.lit("note").alias("area"), F.lit("moved").alias("change_type"), F.lit("note_moved").alias("difference_category"), F.lit("").alias("identifier"), F.col("new_page").alias("page"))
    return pages.unionByName(moved)


EXACT_CHANGES = PAGES + """, changes AS (
  SELECT spec, 'page' AS area, 'removed' AS change_type, 'page_removed' AS difference_category FROM items i WHERE version = 1 AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.spec = i.spec AND e.old_idx = i.idx)
  UNION ALL SELECT spec, 'page', 'added', 'page_added' FROM items i WHERE version = 2 AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.spec = i.spec AND e.new_idx = i.idx)
  UNION ALL SELECT spec, 'note', 'moved', 'note_moved' FROM exact WHERE old_page <> new_page)"""


@query("change_summary", EXACT_CHANGES + " SELECT spec, area, change_type, difference_category, count(*) AS n FROM changes GROUP BY GROUPING SETS ((spec), (spec, area), (spec, change_type), (spec, difference_category))")
def _(spark, d):
    return reports.summary(exact_changes(spark, d), ("spec",))


@query("report_buckets", EXACT_CHANGES + """, layout(ord, report_section, bucket) AS (VALUES
  (0, 'Critical Changes', 'requirement_changes'), (1, 'Critical Changes', 'numeric_changes'), (2, 'Critical Changes', 'requirement_strength_changes'),
  (3, 'Content Changes', 'modified_tables'), (4, 'Content Changes', 'modified_figures'), (5, 'Content Changes', 'modified_notes'),
  (6, 'Structural Changes', 'sections_added'), (7, 'Structural Changes', 'sections_removed'), (8, 'Structural Changes', 'pages_added'), (9, 'Structural Changes', 'pages_removed'),
  (10, 'Relocations', 'moved_tables'), (11, 'Relocations', 'moved_notes'), (12, 'Relocations', 'moved_figures'), (13, 'Relocations', 'page_shifts'),
  (14, 'Metadata', 'metadata_title'), (15, 'Metadata', 'metadata_version'), (16, 'Metadata', 'metadata_revision')),
named AS (SELECT spec, CASE WHEN area = 'page' AND change_type = 'added' THEN 'pages_added' WHEN area = 'page' AND change_type = 'removed' THEN 'pages_removed' ELSE 'moved_notes' END AS bucket FROM changes)
SELECT s.spec, CAST(l.ord AS INT) AS ord, l.report_section, l.bucket, count(n.bucket) AS n FROM layout l CROSS JOIN (SELECT DISTINCT spec FROM named) s LEFT JOIN named n ON n.spec = s.spec AND n.bucket = l.bucket GROUP BY ALL""")
def _(spark, d):
    return reports.bucket_counts(exact_changes(spark, d), ("spec",))


@query("changed_pages", EXACT_CHANGES.replace("SELECT spec, 'page' AS area", "SELECT page_number AS page, spec, 'page' AS area").replace("UNION ALL SELECT spec, 'page'", "UNION ALL SELECT page_number, spec, 'page'").replace("UNION ALL SELECT spec, 'note'", "UNION ALL SELECT new_page, spec, 'note'") + " SELECT DISTINCT CAST(page AS VARCHAR) AS page FROM changes")
def _(spark, d):
    return reports.changed_pages(exact_changes(spark, d))


def all_changes(spark: SparkSession, d: str) -> DataFrame:
    return facade.compare_pages(side(spark, d, 1), side(spark, d, 2))


@query("all_changes")
def _(spark, d):
    return all_changes(spark, d)


@query("content_changes")
def _(spark, d):
    old, new = (facade.version_tables(side(spark, d, v))["note"] for v in (1, 2))
    return compare.numbered(compare.area_changes(old, new, "note"))


@query("page_changes")
def _(spark, d):
    return compare.numbered(compare.page_changes(page_items(spark, d, 1), page_items(spark, d, 2)))


@query("change_cards")
def _(spark, d):
    changes = QUERIES["content_changes"](spark, d)
    return changes.select("spec", "change_id", reports.cards().alias("card"))


@query("report_rows")
def _(spark, d):
    return reports.csv_rows(QUERIES["content_changes"](spark, d))


@query("word_diffs")
def _(spark, d):
    a = side(spark, d, 1).select("spec", "page_number", F.col("text").alias("a"))
    b = side(spark, d, 2).select("spec", (F.col("page_number") - 1).alias("page_number"), F.col("text").alias("b"))
    return a.join(b, ["spec", "page_number"]).filter("a <> b").select("spec", "page_number", udfs.word_diff(F.col("a"), F.col("b")).alias("diff")).select("spec", "page_number", "diff.old", "diff.new")


def _cells(spark: SparkSession, d: str, version: int) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet").withColumn("row_idx", (F.col("p_partkey") % 40).cast("int")).withColumn("spec", F.col("p_brand"))
    price = F.when((F.lit(version) == 2) & (F.col("p_partkey") % 97 == 0), F.col("p_size") + 1).otherwise(F.col("p_size"))
    rows = part.groupBy("spec", "row_idx").agg(F.max(price).alias("size"), F.max("p_type").alias("type"))
    if version == 2:
        rows = rows.filter(~((F.length("spec") + F.substring("spec", -1, 1).cast("int")) % 3 == 0) | (F.col("row_idx") != 7))
    return rows.select("spec", "row_idx", F.posexplode(F.array(F.col("size").cast("string"), F.col("type"))).alias("col_idx", "cell"))


_CELL_SQL = """WITH v AS (SELECT 1 AS version UNION ALL SELECT 2), raw AS (SELECT p_brand AS spec, version, CAST(p_partkey % 40 AS INT) AS row_idx, max(CASE WHEN version = 2 AND p_partkey % 97 = 0 THEN p_size + 1 ELSE p_size END) AS size, max(p_type) AS type FROM part CROSS JOIN v GROUP BY ALL),
kept AS (SELECT * FROM raw WHERE version = 1 OR NOT ((length(spec) + CAST(right(spec, 1) AS INT)) % 3 = 0) OR row_idx <> 7),
cells AS (SELECT spec, version, row_idx, 0 AS col_idx, CAST(size AS VARCHAR) AS cell FROM kept UNION ALL SELECT spec, version, row_idx, 1, type FROM kept),
counts AS (SELECT spec, count(DISTINCT row_idx) FILTER (version = 1) AS a, count(DISTINCT row_idx) FILTER (version = 2) AS b FROM cells GROUP BY spec),
met AS (SELECT coalesce(x.spec, y.spec) AS spec, coalesce(x.row_idx, y.row_idx) AS row_idx, coalesce(x.col_idx, y.col_idx) AS col_idx, coalesce(x.cell, '') AS old_cell, coalesce(y.cell, '') AS new_cell FROM (SELECT * FROM cells WHERE version = 1) x FULL JOIN (SELECT * FROM cells WHERE version = 2) y ON x.spec = y.spec AND x.row_idx = y.row_idx AND x.col_idx = y.col_idx),
diff AS (SELECT spec, count(*) AS n_cells, min({'row_idx': row_idx, 'col_idx': col_idx, 'old_cell': old_cell, 'new_cell': new_cell}) AS f FROM met WHERE old_cell <> new_cell GROUP BY spec),
named AS (SELECT c.spec, CASE WHEN b > a THEN 'Row added' WHEN b < a THEN 'Row removed' WHEN n_cells = 1 THEN '1 cell changed' WHEN n_cells > 1 THEN n_cells || ' cells changed' END AS kind, coalesce(n_cells, 0) AS n_cells, f FROM counts c LEFT JOIN diff USING (spec))
SELECT spec, kind, n_cells, f.row_idx AS row_idx, f.col_idx AS col_idx, f.old_cell AS old_cell, f.new_cell AS new_cell FROM named WHERE kind IS NOT NULL"""


@query("table_cell_diff", _CELL_SQL)
def _(spark, d):
    return compare.table_differences(_cells(spark, d, 1), _cells(spark, d, 2))


# Quality --------------------------------------------------------------------------------------------------------------


def _f1_sql(keys: str) -> str:
    """F1 of counters keys(spec, version, key), version 1 against 2."""
    return f""", k AS ({keys}), c AS (SELECT spec, key, count(*) FILTER (version = 1) AS a, count(*) FILTER (version = 2) AS b FROM k GROUP BY ALL),
s AS (SELECT spec, sum(least(a, b)) AS tp, sum(a) AS a, sum(b) AS b FROM c GROUP BY spec) SELECT spec, round(CASE WHEN a = 0 AND b = 0 THEN 100.0::DOUBLE WHEN a = 0 OR b = 0 THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * tp / (a + b) END, 6) AS f1 FROM s"""


@query("f1_requirements", REQUIREMENTS + _f1_sql("SELECT spec, version, lower(category) || '|' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM requirements"))
def _(spark, d):
    a, b = (quality.requirement_counter(extract.requirements(side(spark, d, v), ("spec",))) for v in (1, 2))
    return quality.f1(a, b)


@query("f1_captions", CAPTIONS + _f1_sql("SELECT spec, version, lower(caption) AS key FROM captions"))
def _(spark, d):
    a, b = (quality.counter(extract.table_captions(side(spark, d, v), ("spec",)), tx.quality_text("caption")) for v in (1, 2))
    return quality.f1(a, b)


@query("f1_signals", CORPUS + _f1_sql(f"SELECT spec, version, upper(unnest(regexp_extract_all(text, '{lx.AXI_SIGNAL}'))) AS key FROM corpus"))
def _(spark, d):
    a, b = (extract.token_counts(side(spark, d, v), lx.AXI_SIGNAL, ("spec",)) for v in (1, 2))
    return quality.f1(a, b)


@query("requirement_recall", REQUIREMENTS + f", l AS (SELECT spec, version, sum(len(list_filter(string_split(text, chr(10)), lambda x: {sql_phrases(lx.SPECIFICATION_PHRASES, 'x')}))) AS expected FROM corpus GROUP BY ALL), r AS (SELECT spec, version, count(*) AS found FROM requirements GROUP BY ALL) SELECT spec, version, CAST(expected AS BIGINT) AS expected, coalesce(found, 0) AS found, round(CASE WHEN expected = 0 THEN 100.0::DOUBLE ELSE least(100.0::DOUBLE, 100.0::DOUBLE * coalesce(found, 0) / expected) END, 6) AS recall FROM l LEFT JOIN r USING (spec, version)")
def _(spark, d):
    pages = corpus(spark, d)
    return quality.requirement_recall(pages, extract.requirements(pages), PAGE)


XREFS = r""", refs AS (SELECT DISTINCT spec, version, lower(unnest(list_concat(regexp_extract_all(text, '(?i)Section\s+\d+(?:\.\d+)*'), regexp_extract_all(text, '(?i)Table\s+[A-Za-z]?\d+(?:[-.]\d+)*')))) AS ref FROM corpus)"""


@query("xref_recall", CORPUS + XREFS + " SELECT a.spec, count(*) AS expected, count(b.ref) AS captured, round(100.0::DOUBLE * count(b.ref) / count(*), 6) AS recall FROM refs a LEFT JOIN refs b ON a.spec = b.spec AND a.ref = b.ref AND b.version = 2 WHERE a.version = 1 GROUP BY a.spec")
def _(spark, d):
    a, b = (extract.cross_references(side(spark, d, v), ("spec",), figures=False).select("spec", F.lower("ref").alias("ref")) for v in (1, 2))
    return quality.reference_recall(a, b)


@query("xref_resolve", CAPTIONS + r""", refs AS (SELECT spec, version, unnest(list_concat(regexp_extract_all(text, '(?i)Section\s+\d+(?:\.\d+)*'), regexp_extract_all(text, '(?i)Table\s+[A-Za-z]?\d+(?:[-.]\d+)*'))) AS ref FROM corpus),
parts AS (SELECT spec, version, lower(regexp_extract(ref, '(?i)^(Section|Table)\s+(.*)$', 1)) AS kind, lower(regexp_extract(ref, '(?i)^(Section|Table)\s+(.*)$', 2)) AS number FROM refs),
known AS (SELECT DISTINCT spec, version, lower(regexp_extract(caption, '(?i)^Table\s+([A-Za-z]?\d+(?:[-.]\d+)*)', 1)) AS number FROM captions)
SELECT p.spec, p.version, count(*) AS total, count(k.number) AS resolved, count(*) = count(k.number) AS ok FROM parts p LEFT JOIN known k ON p.kind = 'table' AND p.spec = k.spec AND p.version = k.version AND p.number = k.number GROUP BY ALL""")
def _(spark, d):
    pages = corpus(spark, d)
    found = extract.requirements(pages).withColumn("section", F.lit(None).cast("string"))
    return quality.references_resolve(extract.cross_references(pages, figures=False), found, extract.table_captions(pages), PAGE)


@query("traceability", REQUIREMENTS + ", whole AS (SELECT spec, version, lower(trim(regexp_replace(string_agg(text, chr(10) ORDER BY page_number), '\\s+', ' ', 'g'))) AS w FROM corpus GROUP BY ALL), each AS (SELECT r.spec, r.version, contains(w, lower(trim(regexp_replace(r.text, '\\s+', ' ', 'g')))) AS ok FROM requirements r JOIN whole USING (spec, version)) SELECT spec, version, count(*) AS total, count(*) FILTER (ok) AS traced, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 6) AS share FROM each GROUP BY ALL")
def _(spark, d):
    pages = corpus(spark, d)
    return quality.traceability(pages, extract.requirements(pages), PAGE)


@query("covered_pages", HEADINGS + ", own AS (SELECT spec, version, min(page_number) AS f FROM headings GROUP BY ALL) SELECT c.spec, c.version, count(DISTINCT c.page_number) AS covered FROM corpus c JOIN own USING (spec, version) WHERE c.page_number >= f GROUP BY ALL")
def _(spark, d):
    return quality.covered_pages(extract.semantic_chunks(corpus(spark, d)), PAGE)


@query("category_consistency", REQUIREMENTS + f", s AS (SELECT *, {_sql_scored('text')} AS top FROM requirements) SELECT spec, version, count(*) AS checks, count(*) FILTER (category = CASE WHEN top.hits > 0 THEN top.name ELSE 'Functional' END) AS matches, round(100.0::DOUBLE * count(*) FILTER (category = CASE WHEN top.hits > 0 THEN top.name ELSE 'Functional' END) / count(*), 6) AS share FROM s GROUP BY ALL")
def _(spark, d):
    return quality.category_consistency(extract.requirements(corpus(spark, d)), PAGE, scored=True)


@query("internal_checks", REQUIREMENTS + SECTIONS.removeprefix(CORPUS) + r" SELECT spec, version, bool_and(regexp_matches(section, '^[A-C]\d+(?:\.\d+)*$')) AS ok FROM requirements JOIN page_section USING (spec, version, page_number) GROUP BY ALL")
def _(spark, d):
    pages = corpus(spark, d)
    return quality.section_formats(extract.requirements(pages).join(extract.page_sections(pages), [*PAGE, "page_number"]), PAGE)


@query("completeness", HEADINGS + """, n AS (SELECT spec, count(*) FILTER (version = 1) AS n, count(*) FILTER (version = 2) AS pages, sum(length(text)) FILTER (version = 1) AS chars, sum(length(text)) FILTER (version = 2) AS got FROM corpus GROUP BY spec HAVING count(*) FILTER (version = 1) > 0),
own AS (SELECT spec, min(page_number) AS f FROM headings WHERE version = 2 GROUP BY spec), cov AS (SELECT c.spec, count(DISTINCT page_number) AS covered FROM corpus c JOIN own USING (spec) WHERE version = 2 AND page_number >= f GROUP BY c.spec),
w AS (SELECT n.*, coalesce(covered, 0) AS covered FROM n LEFT JOIN cov USING (spec)),
v AS (SELECT spec, unnest(['page_coverage', 'text_coverage', 'semantic_chunk_coverage', 'record_field_completeness']) AS component,
  unnest([least(100.0::DOUBLE, 100.0::DOUBLE * coalesce(pages, 0) / n), least(100.0::DOUBLE, 100.0::DOUBLE * least(coalesce(got, 0), chars) / chars), least(100.0::DOUBLE, 100.0::DOUBLE * covered / n), 100.0::DOUBLE]) AS value FROM w)
SELECT spec, 'completeness' AS score, component, round(value, 6) AS value FROM v""")
def _(spark, d):
    a, b = side(spark, d, 1), side(spark, d, 2)
    return quality.completeness(a, b, extract.requirements(b, ("spec",)), extract.semantic_chunks(b, by=("spec",)))


@query("top_issues", ORACLES["completeness"].replace("SELECT spec, 'completeness' AS score, component, round(value, 6) AS value FROM v", "SELECT spec, component, round(value, 6) AS value, CASE WHEN round(value, 6) < 60 THEN 'red' ELSE 'orange' END AS colour FROM v WHERE round(value, 6) < 95 ORDER BY round(value, 6), component, spec LIMIT 6"))
def _(spark, d):
    return reports.top_issues(QUERIES["completeness"](spark, d).drop("score"))


@query("page_fidelity")
def _(spark, d):
    return quality.page_fidelity(side(spark, d, 1), side(spark, d, 2))


def view_document(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(source pages, a document): version 1 of the view as the source, what is extracted from version 2 as the document."""
    by = ("spec",)
    source, pages = side(spark, d, 1), side(spark, d, 2)
    found, said = kept(extract.headings(pages, by)), kept(extract.requirements(pages, by))
    captions, refs = kept(extract.table_captions(pages, by)), kept(extract.cross_references(pages, by))
    shown = kept(extract.figures(pages, by, found))
    every = F.array(*[F.lit(x) for x in lx.REQUIRED_FIELDS])
    return source, {
        "pages": pages,
        "requirements": kept(said.join(extract.page_sections(pages, found, by), [*by, "page_number"])),
        "page_requirements": said,
        "figures": shown,
        "page_figures": shown,
        "tables": captions.select("spec", F.col("page_number").alias("page"), F.concat(F.lit("table_p"), "page_number", F.lit("_1.csv")).alias("csv_file"), "caption"),
        "table_captions": captions,
        "cross_references": refs,
        "images": captions.select("spec", F.col("page_number").alias("page")).limit(0),
        "chunks": extract.semantic_chunks(pages, found, by),
        "keys": kept(pages.select("spec").distinct().withColumn("keys", every)),
    }


def view_scores(spark: SparkSession, d: str, extended: bool) -> DataFrame:
    source, document = view_document(spark, d)
    tables = quality.counter(extract.table_captions(source, ("spec",)), F.col("page_number").cast("string"))
    none = spark.createDataFrame([], "spec string, key string, n long")
    parts = quality.score_completeness(source, document, extended=extended).unionByName(quality.score_accuracy(source, document, extended=extended))
    return parts.unionByName(quality.score_capture(source, document, tables, none))


@query("accuracy")
def _(spark, d):
    source, document = view_document(spark, d)
    return quality.score_accuracy(source, document, extended=True).withColumn("value", F.round("value", 6))


def _counter_f1(name: str, keys: str) -> str:
    """F1 of counters by spec as a part of the capture score; keys: SELECT spec, version, key."""
    return f"""SELECT s.spec, 'table_figure_capture' AS score, '{name}' AS component, round(CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) = 0 THEN 100.0::DOUBLE WHEN coalesce(a, 0) = 0 OR coalesce(b, 0) = 0 THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * tp / (a + b) END, 6) AS value
FROM specs s LEFT JOIN (SELECT spec, sum(least(x, y)) AS tp, sum(x) AS a, sum(y) AS b FROM (SELECT spec, key, count(*) FILTER (version = 1) AS x, count(*) FILTER (version = 2) AS y FROM ({keys}) GROUP BY ALL) GROUP BY spec) f USING (spec)"""


@query("table_capture", CAPTIONS + ", specs AS (SELECT DISTINCT spec FROM corpus WHERE version = 2) " + _counter_f1("table_detection_f1_score", "SELECT spec, version, CAST(page_number AS VARCHAR) AS key FROM captions")
       + " UNION ALL " + _counter_f1("table_caption_f1_score", "SELECT spec, version, concat(page_number, ':', lower(trim(regexp_replace(caption, '\\s+', ' ', 'g')))) AS key FROM captions")
       + " UNION ALL " + _counter_f1("figure_caption_f1_score", r"SELECT spec, version, concat(page_number, ':', lower(line)) AS key FROM lines WHERE regexp_matches(line, '(?i)^Figure\s+[A-Za-z]?\d+(?:[.\-]\d+)*\s*[:.]\s')")
       + " UNION ALL SELECT s.spec, 'table_figure_capture', 'table_file_existence_score', CASE WHEN count(c.spec) = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END FROM specs s LEFT JOIN captions c ON c.spec = s.spec GROUP BY s.spec"
       + " UNION ALL SELECT spec, 'table_figure_capture', 'image_capture_f1_score', 100.0::DOUBLE FROM specs")
def _(spark, d):
    source, document = view_document(spark, d)
    tables = quality.counter(extract.table_captions(source, ("spec",)), F.col("page_number").cast("string"))
    none = spark.createDataFrame([], "spec string, key string, n long")
    return quality.score_capture(source, document, tables, none)


@query("quality_report")
def _(spark, d):
    return quality.report(quality.score(view_scores(spark, d, False)))


# Consensus ------------------------------------------------------------------------------------------------------------


@query("majority_vote", """WITH f AS (SELECT CAST(user_id % 6 AS INT) AS agent, CAST(day(ts) AS INT) AS page_a, CAST(hour(ts) AS INT) AS page_b, lower(trim(event_type)) AS category FROM events)
SELECT page_a, page_b, '' AS section_a, '' AS section_b, category, count(DISTINCT agent) AS votes FROM f GROUP BY ALL HAVING count(DISTINCT agent) >= 4""")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    found = events.select((F.col("user_id") % 6).cast("int").alias("agent"), F.dayofmonth("ts").alias("page_a"), F.hour("ts").alias("page_b"), F.lit(None).cast("string").alias("section_a"), F.lit(None).cast("string").alias("section_b"), F.col("event_type").alias("category"), F.col("event_id").cast("string").alias("reason"))
    return consensus.majority(found).drop("descriptions")


