"""Commit, path, url and store queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.functions import commit_text as ct
from gitstrata.functions import paths
from gitstrata.operators import commits as ops
from gitstrata.plans.registry import query
from gitstrata.rules import languages
from gitstrata.session import shared_folder
from gitstrata.sources import stores

SUFFIX = "lower(regexp_extract({p}, '[^/]+(\\.[^./]+)$', 1))"


def any_of(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def language_sql(view: str, frame: str, path: str, extra: str) -> str:
    rows = ", ".join(f"('{s}', '{lang}')" for s, lang in languages.suffix_rows(view))
    default = languages.MAPS[view][1]
    return f"""
WITH m(suffix, language) AS (VALUES {rows})
SELECT {extra}, coalesce(m.language, '{default}') AS language, count(*) AS n FROM {frame} LEFT JOIN m ON m.suffix = {SUFFIX.format(p=path)} GROUP BY ALL"""


@query("language_commit", language_sql("commit", "f_code c", "c.path", "repository_id"), "f_code")
def _(t):
    code = t.f_code.drop("language")
    return paths.with_language(code, "commit", "path").groupBy("repository_id", "language").agg(F.count("*").alias("n"))


for _view in ("incremental", "security", "performance", "architecture"):
    @query(f"language_{_view}", language_sql(_view, "f_file_changes c", "c.file_path", "change_type"), "f_file_changes")
    def _(t, view=_view):
        return paths.with_language(t.f_file_changes, view).groupBy("change_type", "language").agg(F.count("*").alias("n"))


@query("drop_skipped", """
SELECT hash, file_path FROM (SELECT hash, CASE WHEN additions % 5 = 0 THEN 'node_modules/' || file_path WHEN additions % 7 = 0 THEN file_path || '.PNG' WHEN additions % 11 = 0 THEN 'x/.env.local' ELSE file_path END AS file_path FROM f_file_changes)
WHERE NOT regexp_matches(file_path, '(?i)\\.git/|node_modules/|__pycache__/|\\.(jpg|jpeg|png|gif|pdf|docx?)$|\\.(pyc|lock)$|\\.env')""", "f_file_changes")
def _(t):
    a = F.col("additions")
    path = (F.when(a % 5 == 0, F.concat(F.lit("node_modules/"), "file_path")).when(a % 7 == 0, F.concat("file_path", F.lit(".PNG")))
            .when(a % 11 == 0, "x/.env.local").otherwise(F.col("file_path")))
    return ops.drop_skipped(t.f_file_changes.select("hash", path.alias("file_path")))


@query("analyzable_files", f"""
SELECT path FROM f_code WHERE {SUFFIX.format(p='path')} IN ({", ".join(repr(s) for s in languages.SNAPSHOT_SOURCE + languages.SNAPSHOT_CONFIG)})
UNION ALL SELECT path FROM f_manifests WHERE {SUFFIX.format(p='path')} IN ({", ".join(repr(s) for s in languages.SNAPSHOT_SOURCE + languages.SNAPSHOT_CONFIG)})
 OR lower(regexp_extract(path, '[^/]*$')) IN ({", ".join(repr(s) for s in languages.SNAPSHOT_NAMES)})""", "f_code f_manifests")
def _(t):
    return t.f_code.select("path").unionByName(t.f_manifests.select("path")).filter(paths.is_analyzable("path"))


@query("recent_commits", """
SELECT repository_id, hash, committed_date FROM f_commits QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY committed_date DESC, hash) <= 100""", "f_commits")
def _(t):
    return ops.recent_commits(t.f_commits, 100).select("repository_id", "hash", "committed_date")


@query("page_commits", """
SELECT hash, committed_date, (SELECT count(*) FROM f_commits) AS total, 150 < (SELECT count(*) FROM f_commits) AS has_more
FROM f_commits ORDER BY committed_date DESC, hash LIMIT 50 OFFSET 100""", "f_commits")
def _(t):
    return stores.page(t.f_commits.select("hash", "committed_date"), [F.desc("committed_date"), "hash"], 50, 100)


@query("deep_page", """
SELECT hash, committed_date, CAST(row_number() OVER (ORDER BY committed_date DESC, hash) - 1 AS BIGINT) AS position, (SELECT count(*) FROM f_commits) AS total, 10050 < (SELECT count(*) FROM f_commits) AS has_more
FROM f_commits ORDER BY committed_date DESC, hash LIMIT 50 OFFSET 10000""", "f_commits")
def _(t):
    path = shared_folder(t.spark, "pages")
    stores.write_ranked(t.f_commits.select("hash", "committed_date"), [F.desc("committed_date"), "hash"], path)
    return stores.ranked_page(t.spark, path, 50, 10_000)


@query("next_page", """
SELECT hash, committed_date FROM f_commits WHERE committed_date < TIMESTAMP '1995-06-01' OR (committed_date = TIMESTAMP '1995-06-01' AND hash > '5') ORDER BY committed_date DESC, hash LIMIT 50""", "f_commits")
def _(t):
    rows, last = t.f_commits.select("hash", "committed_date"), {"committed_date": F.lit("1995-06-01").cast("timestamp_ntz"), "hash": F.lit("5")}
    return stores.page_after(rows, {"committed_date": "desc", "hash": "asc"}, last, 50)


ROLLUP_BY_REPOSITORY = """
WITH f AS (SELECT CAST(l_suppkey % 40 AS VARCHAR(20)) AS repository_id, CAST(l_orderkey AS VARCHAR(20)) AS hash, CASE WHEN l_suppkey % 9 = 0 THEN 'api/' ELSE 'src/' END || 'f.py' AS file_path, CAST(l_quantity AS BIGINT) AS additions, CAST(round(l_tax * 1000) AS BIGINT) AS deletions FROM {lineitem})"""


@query("commit_rollup_by_repository", ROLLUP_BY_REPOSITORY.format(lineitem="lineitem") + """
SELECT repository_id, hash, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, count(*) AS files, bool_or(starts_with(file_path, 'api/')) AS is_breaking FROM f GROUP BY 1, 2""")
def _(t):
    """One hash in several repositories (forks): every repository has its own figures."""
    changes = t.spark.sql(ROLLUP_BY_REPOSITORY + " SELECT * FROM f", lineitem=t.lineitem)
    return ops.commit_rollup(changes).select("repository_id", "hash", "additions", "deletions", "files", "is_breaking")


@query("by_repository", "SELECT repository_id, hash, message FROM f_commits WHERE repository_id = '7'", "f_commits")
def _(t):
    return stores.by_repository(t.f_commits, "7").select("repository_id", "hash", "message")


@query("append_commits", """
SELECT repository_id, hash, max(message) AS message FROM (SELECT repository_id, hash, message FROM f_commits WHERE committed_date < TIMESTAMP '1997-01-01'
 UNION ALL SELECT repository_id, hash, 'again ' || message FROM f_commits WHERE committed_date >= TIMESTAMP '1997-01-01') GROUP BY 1, 2""", "f_commits")
def _(t):
    cols = ["repository_id", "hash", "message"]
    old = t.f_commits.filter("committed_date < '1997-01-01'").select(*cols)
    batch = t.f_commits.filter("committed_date >= '1996-01-01'").select("repository_id", "hash", F.concat(F.lit("again "), "message").alias("message"))
    return stores.append_commits(old, batch.unionByName(batch))


TECH = """
SELECT CAST(l_suppkey % 10 AS VARCHAR(9)) AS repository_id, p_name AS name, p_type AS category, p_brand AS version, CAST(l_quantity AS BIGINT) AS usage_count, l_shipdate AS first_seen, l_shipdate AS last_seen
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


@query("merge_technologies", f"""
WITH u AS ({TECH.format(lineitem='lineitem', part='part')})
SELECT repository_id, name, category, CAST(sum(usage_count) AS BIGINT) AS usage_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max_by(version, (last_seen, version)) AS version FROM u GROUP BY 1, 2, 3""")
def _(t):
    rows = t.spark.sql(TECH, lineitem=t.lineitem, part=t.part)
    stored = stores.merge_technologies(rows.filter("last_seen < '1996-01-01'"), rows.limit(0))
    return stores.merge_technologies(stored.select(rows.columns), rows.filter("last_seen >= '1996-01-01'"))


@query("ensure_patterns", """
SELECT pattern_id, name, category FROM f_patterns UNION ALL
SELECT sha256(name) AS pattern_id, name, NULL AS category FROM (SELECT DISTINCT p_name AS name FROM part) WHERE name NOT IN (SELECT name FROM f_patterns)""", "f_patterns")
def _(t):
    dim = t.f_patterns.select("pattern_id", "name", "category")
    return stores.ensure_rows(dim, t.part.select(F.col("p_name").alias("name")), "name", "pattern_id")


@query("ensure_repositories", """
WITH d AS (SELECT repository_id, url FROM f_repositories WHERE status = 'completed')
SELECT repository_id, url FROM d UNION ALL SELECT sha256(url), url FROM (SELECT DISTINCT url FROM f_repositories UNION SELECT DISTINCT regexp_replace(url, '\\?.*', '') FROM pages) WHERE url NOT IN (SELECT url FROM d)""", "f_repositories")
def _(t):
    dim = t.f_repositories.filter("status = 'completed'").select("repository_id", "url")
    wanted = t.f_repositories.select("url").unionByName(t.pages.select(F.regexp_replace("url", r"\?.*", "").alias("url")))
    return stores.ensure_rows(dim, wanted, "url", "repository_id")


@query("append_log", """
SELECT 'model' || CAST(user_id % 3 AS VARCHAR) AS model_id, count(*) AS runs, CAST(sum(event_id) AS BIGINT) AS candidates FROM events GROUP BY 1""")
def _(t):
    path = shared_folder(t.spark, "run-log")
    rows = t.events.select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit("https://example.com/r.git").alias("repo_url"),
        F.concat(F.lit("model"), (F.col("user_id") % 3).cast("string")).alias("model_id"), F.lit(1).cast("long").alias("commit_count"),
        F.col("event_id").alias("candidates"), F.lit(0).cast("long").alias("estimated_tokens"),
        F.create_map("event_type", F.lit(1).cast("long")).alias("task_counts"), F.col("value").alias("duration_seconds"))
    stores.append_log(rows.filter("event_type = 'error'"), path)
    stores.append_log(rows.filter("event_type <> 'error'"), path)
    log = stores.read_log(t.spark, path)
    return log.groupBy("model_id").agg(F.count("*").alias("runs"), F.sum("candidates").alias("candidates"))


# Every table and its key.
COPIED = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
    "labels": "doc_id", "conversations": "conv_id",
}


@query("copy_tables", """
""" + " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n, CAST(sum({key}) AS BIGINT) AS key_sum FROM {name}" for name, key in COPIED.items()))
def _(t):
    root = shared_folder(t.spark, "copy")
    stores.copy_tables(lambda n: t.spark.read.parquet(t.path(n)), lambda n, df: df.write.parquet(f"{root}/{n}"), list(COPIED))
    parts = [t.spark.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("table_name"), F.count("*").alias("n"), F.sum(F.col(k).cast("long")).alias("key_sum")) for n, k in COPIED.items()]
    return reduce(DataFrame.unionByName, parts)


@query("drop_expired", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 DAY")
def _(t):
    return stores.drop_expired(t.events.select("event_id", "ts"), "ts", ttl_days=12)


@query("drop_expired_own", "SELECT session_id, completed_at FROM f_analysis_sessions WHERE completed_at IS NULL OR completed_at > TIMESTAMP '1997-06-01'", "f_analysis_sessions")
def _(t):
    as_of = F.lit("1997-06-01").cast("timestamp_ntz")
    return stores.drop_expired(t.f_analysis_sessions.select("session_id", "completed_at"), "completed_at", as_of=as_of)


URLS = """
SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN ' git@github.com:org/' || lower(c_name) || '.git' WHEN 1 THEN 'git://gitlab.com/a/' || c_mktsegment
 WHEN 2 THEN 'bitbucket.org/x/' || c_name WHEN 3 THEN 'HTTPS://github.com/y/' || c_mktsegment || '.git?x=1' WHEN 4 THEN 'ftp://github.com/z'
 WHEN 5 THEN 'https://example.com/' || c_mktsegment || '?q=2' ELSE 'git@host.io:' || c_mktsegment END AS url FROM {customer}"""


@query("normalize_git_url", f"""
WITH u AS ({URLS.format(customer='customer')}), s AS (SELECT id, trim(url) AS u FROM u), p AS (SELECT id, u, regexp_replace(u, '^git://', 'https://') AS v FROM s),
 f AS (SELECT id, u, CASE WHEN contains(v, '://') THEN v ELSE 'https://' || v END AS w FROM p),
 x AS (SELECT id, u, regexp_extract(w, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(.*)$', ['scheme', 'host', 'path', 'tail']) AS r FROM f)
SELECT id, CASE WHEN regexp_matches(u, '^git@') THEN 'https://' || regexp_extract(u, '^git@([^:]+):', 1) || '/' || regexp_replace(regexp_extract(u, ':(.+)$', 1), '\\.git$', '') || '.git'
 WHEN lower(r.scheme) IN ('http', 'https') THEN lower(r.scheme) || '://' || r.host || r.path || CASE WHEN regexp_matches(r.host, 'github.com|gitlab.com|bitbucket.org') AND NOT ends_with(r.path, '.git') THEN '.git' ELSE '' END || r.tail END AS normalized FROM x""")
def _(t):
    rows = t.spark.sql(URLS, customer=t.customer)
    return rows.select("id", ct.normalize_git_url(F.col("url")).alias("normalized"))


INTENT = f"""CASE WHEN {any_of('lower(message)', ct.FEATURE_WORDS)} THEN 'feature' WHEN {any_of('lower(message)', ct.BUGFIX_WORDS)} THEN 'bugfix'
 WHEN {any_of('lower(message)', ct.REFACTOR_WORDS)} THEN 'refactoring' ELSE 'other' END"""


@query("classify_commits", f"""
SELECT hash, repository_id, {INTENT} AS intent, {any_of('lower(message)', ct.BREAKING_WORDS)} AS is_breaking_message,
 CASE WHEN q >= 2 THEN 'good' WHEN q = 1 THEN 'fair' ELSE 'poor' END AS message_quality,
 CASE WHEN {any_of('author_email', ct.FREE_MAIL)} THEN 'intermediate' WHEN {any_of('author_email', ct.COMPANY_MAIL)} THEN 'experienced' ELSE 'junior' END AS author_class
FROM (SELECT *, CAST(regexp_matches(message, '^(feat:|fix:|refactor:|docs:|test:)') AS INTEGER) + CAST(length(message) > 20 AS INTEGER) + CAST(regexp_matches(message, '^\\p{{Lu}}') AS INTEGER) AS q FROM f_commits)""".replace("{{", "{").replace("}}", "}"), "f_commits")
def _(t):
    return ops.classify_commits(t.f_commits).select("hash", "repository_id", "intent", "is_breaking_message", "message_quality", "author_class")


@query("message_intent_text", f"""
SELECT doc_id, {INTENT.replace('message', 'text')} AS intent, {any_of('lower(text)', ct.BREAKING_WORDS)} AS breaking,
 {any_of('lower(source)', ct.BREAKING_PATHS)} AS path_breaking, length(text) // 4 AS tokens FROM documents""")
def _(t):
    text = F.col("text")
    return t.documents.select("doc_id", ct.commit_intent(text).alias("intent"), ct.breaking_message(text).alias("breaking"),
                              ct.breaking_path(F.col("source")).alias("path_breaking"), ct.token_estimate(text).alias("tokens"))


@query("token_estimate", "SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.sum(ct.token_estimate(F.col("text"))).alias("tokens"))


@query("change_type", "SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'A' THEN 'added' WHEN l_returnflag = 'R' THEN 'deleted' WHEN l_linestatus = 'O' THEN 'renamed' ELSE 'modified' END AS change_type, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    kind = ct.change_type(F.col("l_returnflag") == "A", F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", kind.alias("change_type")).agg(F.count("*").alias("n"))


@query("diff_counts", """
SELECT doc_id, len(regexp_extract_all(d, '\\n\\+')) AS additions, len(regexp_extract_all(d, '\\n-')) AS deletions
FROM (SELECT doc_id, replace(replace(text, '. ', chr(10) || '+'), ', ', chr(10) || '-') AS d FROM documents)""")
def _(t):
    diff = F.replace(F.replace("text", F.lit(". "), F.lit("\n+")), F.lit(", "), F.lit("\n-"))
    return t.documents.select("doc_id", ct.diff_additions(diff).alias("additions"), ct.diff_deletions(diff).alias("deletions"))


ROLLUP = f"""
WITH c AS (SELECT hash, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, count(*) AS files,
  avg(CASE WHEN additions > 0 AND deletions > 0 AND abs(additions - deletions) / greatest(additions + deletions, 1) < 0.3 THEN 1 ELSE 0 END) AS refactoring_score,
  bool_or({any_of('lower(file_path)', ct.BREAKING_PATHS)}) AS path_break FROM f_file_changes GROUP BY 1),
 m AS (SELECT hash, bool_or({any_of('lower(message)', ct.BREAKING_WORDS)}) AS mark FROM f_commits GROUP BY 1),
 j AS (SELECT c.*, path_break OR coalesce(mark, false) AS is_breaking, additions + deletions AS commit_size FROM c LEFT JOIN m USING (hash)),
 p AS (SELECT *, CASE WHEN commit_size > 500 THEN 3 WHEN commit_size > 200 THEN 2 WHEN commit_size > 50 THEN 1 ELSE 0 END + CASE WHEN files > 10 THEN 2 WHEN files > 5 THEN 1 ELSE 0 END + CASE WHEN is_breaking THEN 3 ELSE 0 END AS pts FROM j)
"""


@query("commit_rollup", ROLLUP + """
SELECT hash, additions, deletions, files, round(refactoring_score, 9) AS refactoring_score, is_breaking, additions - deletions AS net_lines, commit_size,
 refactoring_score > 0.3 AS is_refactoring, 'low' AS complexity_impact, CASE WHEN pts >= 5 THEN 'high' WHEN pts >= 3 THEN 'medium' ELSE 'low' END AS risk_level, CAST(0 AS BIGINT) AS complexity_change FROM p""", "f_file_changes f_commits")
def _(t):
    return ops.commit_rollup(t.f_file_changes, t.f_commits).withColumn("refactoring_score", F.round("refactoring_score", 9))


@query("complexity_impact", """
SELECT l_orderkey, CASE WHEN abs(s) > 50 THEN 'high' WHEN abs(s) > 20 THEN 'medium' ELSE 'low' END AS impact FROM (SELECT l_orderkey, CAST(sum(l_quantity - 25) AS BIGINT) AS s FROM lineitem GROUP BY 1)""")
def _(t):
    changes = t.lineitem.select(F.col("l_orderkey").alias("hash"), F.lit("a.py").alias("file_path"), F.lit(1).cast("long").alias("additions"),
                                F.lit(0).cast("long").alias("deletions"), (F.col("l_quantity") - 25).alias("complexity_change"))
    return ops.commit_rollup(changes).select(F.col("hash").alias("l_orderkey"), F.col("complexity_impact").alias("impact"))


@query("commits_summary", """
WITH c AS (SELECT repository_id, f_commits.hash, committed_date, author_email, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions FROM f_commits LEFT JOIN (SELECT hash, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM f_file_changes GROUP BY 1) USING (hash)),
 r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY committed_date DESC, hash) <= 10)
SELECT repository_id, (SELECT count(*) FROM c WHERE c.repository_id = r.repository_id) AS total_commits, CAST(sum(additions) AS BIGINT) AS total_additions, CAST(sum(deletions) AS BIGINT) AS total_deletions, count(DISTINCT author_email) AS unique_authors FROM r GROUP BY 1""", "f_commits f_file_changes")
def _(t):
    lines = t.f_file_changes.groupBy("hash").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return ops.commits_summary(t.f_commits.join(lines, "hash", "left"))


@query("repository_info", """
SELECT repository_id, count(*) AS total_commits, min(committed_date) AS first_commit, max(committed_date) AS last_commit, count(DISTINCT author_email) AS authors FROM f_commits GROUP BY 1""", "f_commits")
def _(t):
    return ops.repository_info(t.f_commits)


@query("grades", """
SELECT o_orderkey, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS percent_grade,
 CASE WHEN u >= 0.9 THEN 'A' WHEN u >= 0.8 THEN 'B' WHEN u >= 0.7 THEN 'C' WHEN u >= 0.6 THEN 'D' ELSE 'F' END AS unit_grade FROM (SELECT o_orderkey, o_totalprice / 5000 AS s, o_totalprice / 500000 AS u FROM orders)""")
def _(t):
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", ct.grade(price / 5000).alias("percent_grade"), ct.grade(price / 500000, "unit").alias("unit_grade"))


@query("fold_category", """
SELECT category, CASE category WHEN 'languages' THEN 'language' WHEN 'frameworks' THEN 'framework' WHEN 'libraries' THEN 'library' WHEN 'tools' THEN 'tool' ELSE 'other' END AS folded, count(*) AS n FROM f_technologies GROUP BY ALL""", "f_technologies")
def _(t):
    return t.f_technologies.groupBy("category", ct.fold_category(F.col("category")).alias("folded")).agg(F.count("*").alias("n"))


@query("canonical_names", "SELECT p_partkey, lower(regexp_replace(p_name || '_' || p_brand, '[^A-Za-z0-9]', '', 'g')) AS canonical, replace(p_name || '_' || p_brand, '_', ' ') AS display FROM part")
def _(t):
    name = F.concat_ws("_", "p_name", "p_brand")
    return t.part.select("p_partkey", ct.canonical(name).alias("canonical"), ct.display_name(name).alias("display"))
