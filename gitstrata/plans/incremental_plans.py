"""Snapshot, update, repository and user queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.operators import incremental as inc
from gitstrata.operators import repositories as repo
from gitstrata.plans.registry import query

SNAP = "f_files f_snapshot_prev f_snapshot_cur"
DIFF = """
WITH d AS (SELECT coalesce(p.repository_id, c.repository_id) AS repository_id, coalesce(p.path, c.path) AS path,
 CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN p.content_hash <> c.content_hash THEN 'modified' END AS change_type
 FROM f_snapshot_prev p FULL JOIN f_snapshot_cur c ON p.repository_id = c.repository_id AND p.path = c.path)
"""


@query("snapshot", """
SELECT repository_id, path, sha256(content) AS content_hash, length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END AS n_lines FROM f_files""", "f_files")
def _(t):
    return inc.snapshot(t.f_files, F.lit("2024-01-01").cast("timestamp_ntz")).drop("snapshot_ts")


@query("diff_snapshots", DIFF + "SELECT repository_id, path, change_type FROM d WHERE change_type IS NOT NULL", SNAP)
def _(t):
    return inc.diff_snapshots(t.f_snapshot_prev, t.f_snapshot_cur).drop("old_hash", "new_hash")


@query("reanalysis_decision", DIFF + """,
 p AS (SELECT repository_id, max(CASE WHEN CAST(substr(repository_id, length(repository_id)) AS VARCHAR) IN ('1', '2') THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-20' END) AS ts FROM f_snapshot_prev GROUP BY 1),
 s AS (SELECT repository_id, count(*) AS total_files FROM f_snapshot_cur GROUP BY 1), g AS (SELECT repository_id, count(*) AS changed_files FROM d WHERE change_type IN ('added', 'modified') GROUP BY 1)
SELECT repository_id, total_files, coalesce(changed_files, 0) AS changed_files, coalesce(changed_files, 0) / total_files AS change_ratio,
 ts IS NULL OR TIMESTAMP '2024-01-22' - ts > INTERVAL 7 DAY OR coalesce(changed_files, 0) / total_files > 0.2 AS full_reanalysis FROM s LEFT JOIN p USING (repository_id) LEFT JOIN g USING (repository_id)""", SNAP)
def _(t):
    old = F.substring("repository_id", -1, 1).isin("1", "2")
    prev = t.f_snapshot_prev.withColumn("snapshot_ts", F.when(old, F.lit("2024-01-01")).otherwise(F.lit("2024-01-20")).cast("timestamp_ntz"))
    return inc.reanalysis_decision(prev, t.f_snapshot_cur, F.lit("2024-01-22").cast("timestamp_ntz"), threshold=0.2)


@query("incremental_candidates", DIFF + """
SELECT f.repository_id, f.path, length(f.content) AS chars, 'unknown' AS language FROM f_files f JOIN d USING (repository_id, path) WHERE change_type IN ('added', 'modified')""", SNAP)
def _(t):
    diff = inc.diff_snapshots(t.f_snapshot_prev, t.f_snapshot_cur)
    out = inc.incremental_candidates(diff, t.f_files)
    return out.select("repository_id", "path", F.length("content").cast("long").alias("chars"), "language")


@query("merge_results", DIFF + """
SELECT repository_id, path, 'old' AS version FROM f_snapshot_prev p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.repository_id = p.repository_id AND d.path = p.path AND change_type IS NOT NULL)
UNION ALL SELECT repository_id, path, 'new' FROM d WHERE change_type IN ('added', 'modified')""", SNAP)
def _(t):
    diff = inc.diff_snapshots(t.f_snapshot_prev, t.f_snapshot_cur)
    old = t.f_snapshot_prev.select("repository_id", "path", F.lit("old").alias("version"))
    fresh = diff.filter("change_type <> 'deleted'").select("repository_id", "path", F.lit("new").alias("version"))
    return inc.merge_results(old, fresh, diff)


@query("backfill", """
SELECT repository_id, coalesce(is_public, true) AS is_public, coalesce(analysis_count, 0) AS analysis_count, coalesce(primary_language, 'unknown') AS primary_language,
 is_public IS NULL OR analysis_count IS NULL OR primary_language IS NULL AS was_updated FROM f_repositories""", "f_repositories")
def _(t):
    cols = t.f_repositories.select("repository_id", "is_public", "analysis_count", "primary_language")
    return inc.backfill(cols, {"is_public": F.lit(True), "analysis_count": F.lit(0), "primary_language": F.lit("unknown")})


@query("backfill_counts", "SELECT count(*) AS rows, count(*) FILTER (file_path IS NULL OR ai_model_used IS NULL) AS updated FROM f_occurrences", "f_occurrences")
def _(t):
    return inc.backfill_counts(inc.backfill(t.f_occurrences, {"file_path": F.lit(""), "ai_model_used": F.lit("unknown")}))


NEXT = "CAST(CAST(repository_id AS INTEGER) % 50 + 1 AS VARCHAR(20))"


def pairs(t):
    """Every repository against the one with the next number."""
    return t.f_technologies.select("repository_id").distinct().select(F.expr(NEXT).alias("repo_a"), F.col("repository_id").alias("repo_b"))


SETS = f"""
WITH r AS (SELECT DISTINCT {NEXT} AS repo_a, repository_id AS repo_b FROM f_technologies), p AS (SELECT repository_id, list(DISTINCT pattern_id) AS names FROM f_name_occurrences GROUP BY 1), t AS (SELECT repository_id, list(DISTINCT name) AS names FROM f_technologies GROUP BY 1),
 z AS (SELECT repo_a, repo_b, coalesce(pa.names, []) AS pa, coalesce(pb.names, []) AS pb, coalesce(ta.names, []) AS ta, coalesce(tb.names, []) AS tb
  FROM r LEFT JOIN p pa ON pa.repository_id = repo_a LEFT JOIN p pb ON pb.repository_id = repo_b LEFT JOIN t ta ON ta.repository_id = repo_a LEFT JOIN t tb ON tb.repository_id = repo_b),
 n AS (SELECT repo_a, repo_b, len(list_intersect(pa, pb)) AS common_patterns, len(pa) - len(list_intersect(pa, pb)) AS only_a_patterns, len(pb) - len(list_intersect(pa, pb)) AS only_b_patterns,
  len(list_intersect(ta, tb)) AS common_technologies, len(ta) - len(list_intersect(ta, tb)) AS only_a_technologies, len(tb) - len(list_intersect(ta, tb)) AS only_b_technologies FROM z)
"""


@query("compare_repositories", SETS + """
SELECT n.*, round(coalesce(common_patterns / nullif(common_patterns + only_a_patterns + only_b_patterns, 0), 0) * 0.7 + coalesce(common_technologies / nullif(common_technologies + only_a_technologies + only_b_technologies, 0), 0) * 0.3, 9) AS similarity_score FROM n""", "f_technologies f_name_occurrences")
def _(t):
    patterns = t.f_name_occurrences.select("repository_id", F.col("pattern_id").alias("name"))
    return inc.compare_pairs(pairs(t), patterns, t.f_technologies).withColumn("similarity_score", F.round("similarity_score", 9))


@query("compared_items", f"""
WITH t AS (SELECT DISTINCT repository_id, name FROM f_technologies), r AS (SELECT DISTINCT {NEXT} AS repo_a, repository_id AS repo_b FROM f_technologies),
 s AS (SELECT repo_a, repo_b, name, 1 AS s FROM r JOIN t ON t.repository_id = repo_a UNION ALL SELECT repo_a, repo_b, name, 2 FROM r JOIN t ON t.repository_id = repo_b)
SELECT repo_a, repo_b, name AS item, CASE sum(s) WHEN 3 THEN 'both' WHEN 1 THEN 'only_a' ELSE 'only_b' END AS found_in FROM s GROUP BY 1, 2, 3""", "f_technologies")
def _(t):
    return inc.compared_items(pairs(t), t.f_technologies)


def related_sql(rows: str, threshold: float) -> str:
    return f"""
WITH r AS ({rows}), f AS (SELECT repository_id, string_agg(name || ':' || weight, ',' ORDER BY name) AS profile, sum(weight) AS total FROM r GROUP BY 1),
 c AS (SELECT repository_id, total, min(repository_id) OVER (PARTITION BY profile) AS class_id FROM f), m AS (SELECT * FROM c WHERE repository_id = class_id),
 s AS (SELECT a.repository_id AS repo_a, b.repository_id AS repo_b, sum(least(a.weight, b.weight)) AS shared FROM r a JOIN r b ON a.name = b.name AND a.repository_id < b.repository_id
  WHERE a.repository_id IN (SELECT class_id FROM m) AND b.repository_id IN (SELECT class_id FROM m) GROUP BY 1, 2),
 p AS (SELECT repo_a, repo_b, shared / (a.total + b.total - shared) AS similarity FROM s JOIN m a ON a.repository_id = repo_a JOIN m b ON b.repository_id = repo_b)
"""


BASKETS = "SELECT CAST(l_orderkey AS VARCHAR(20)) AS repository_id, CAST(l_partkey AS VARCHAR(20)) AS name, CAST(sum(l_quantity) AS BIGINT) AS weight FROM {lineitem} GROUP BY 1, 2"
TRAITS = """SELECT CAST(c_custkey AS VARCHAR(20)) AS repository_id, c_mktsegment AS name, CAST(2 AS BIGINT) AS weight FROM {customer}
 UNION ALL SELECT CAST(c_custkey AS VARCHAR(20)), 'nation' || CAST(c_nationkey AS VARCHAR(20)), CAST(1 AS BIGINT) FROM {customer}"""
COUNTS = "SELECT repository_id, pattern_id AS name, count(*) AS weight FROM f_name_occurrences GROUP BY 1, 2"


@query("related_repositories", related_sql(BASKETS.format(lineitem="lineitem"), 0.3) + "SELECT repo_a, repo_b, round(similarity, 9) AS similarity FROM p WHERE similarity >= 0.3")
def _(t):
    pairs, _ = inc.related_repositories(t.spark.sql(BASKETS, lineitem=t.lineitem), 0.3)
    return pairs.withColumn("similarity", F.round("similarity", 9))


@query("related_by_patterns", related_sql(COUNTS, 0.5) + "SELECT repo_a, repo_b, round(similarity, 9) AS similarity FROM p WHERE similarity >= 0.5", "f_name_occurrences")
def _(t):
    items = t.f_name_occurrences.groupBy("repository_id", F.col("pattern_id").alias("name")).agg(F.count("*").alias("weight"))
    return inc.related_repositories(items, 0.5)[0].withColumn("similarity", F.round("similarity", 9))


@query("repository_classes", related_sql(TRAITS.format(customer="customer"), 0.4) + """, l AS (SELECT repo_a AS class_id FROM p WHERE similarity >= 0.4 UNION ALL SELECT repo_b FROM p WHERE similarity >= 0.4)
SELECT repository_id, class_id, (SELECT count(*) FROM l WHERE l.class_id = c.class_id) AS links FROM c""")
def _(t):
    """Hot items: every repository has one of five names in common with a fifth of the others."""
    pairs, classes = inc.related_repositories(t.spark.sql(TRAITS, customer=t.customer), 0.4)
    ends = pairs.select(F.explode(F.array("repo_a", "repo_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return classes.join(ends, "class_id", "left").select("repository_id", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


ACCESS = """
SELECT CAST(user_id AS VARCHAR(20)) AS user_id, CAST(event_id % 50 AS VARCHAR(20)) AS repository_id, CASE WHEN event_type = 'view' THEN 'viewer' ELSE 'owner' END AS access_type, ts AS created_at, ts AS last_accessed FROM {events}"""


@query("track_access", f"""
WITH e AS ({ACCESS.format(events='events')})
SELECT user_id, repository_id, min(created_at) AS created_at, max(last_accessed) AS last_accessed, max_by(access_type, (last_accessed, access_type)) AS access_type, sha256(user_id || '|' || repository_id) AS association_id FROM e GROUP BY 1, 2""")
def _(t):
    rows = t.spark.sql(ACCESS, events=t.events)
    first = inc.track_access(rows.filter("created_at < '2024-01-10'"), rows.limit(0)).drop("association_id")
    return inc.track_access(first.select(rows.columns), rows.filter("created_at >= '2024-01-10'"))


@query("repository_usage", "SELECT repository_id, count(DISTINCT user_id) AS unique_users, count(*) AS analysis_count FROM f_user_repos GROUP BY 1", "f_user_repos")
def _(t):
    return inc.repository_usage(t.f_user_repos)


@query("remove_access", "SELECT * FROM f_user_repos WHERE access_type <> 'viewer'", "f_user_repos")
def _(t):
    return inc.remove_access(t.f_user_repos, t.f_user_repos.filter("access_type = 'viewer'"))


def repositories(t):
    tags = t.f_repo_tags.groupBy("repository_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return t.f_repositories.join(tags, "repository_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


REPOS = "f_repositories f_repo_tags f_user_repos"


@query("repositories_with_stats", """
SELECT r.repository_id, r.name, coalesce(c.n, 0) AS commits, coalesce(t.n, 0) AS technologies, coalesce(o.n, 0) AS occurrences, coalesce(s.status, 'not_analyzed') AS latest_status
FROM f_repositories r LEFT JOIN (SELECT repository_id, count(*) AS n FROM f_commits GROUP BY 1) c USING (repository_id) LEFT JOIN (SELECT repository_id, count(*) AS n FROM f_technologies GROUP BY 1) t USING (repository_id)
 LEFT JOIN (SELECT repository_id, count(*) AS n FROM f_occurrences GROUP BY 1) o USING (repository_id)
 LEFT JOIN (SELECT repository_id, status FROM f_analysis_sessions QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, session_id DESC) = 1) s USING (repository_id)""",
       "f_repositories f_commits f_technologies f_occurrences f_analysis_sessions")
def _(t):
    out = repo.repositories_with_stats(t.f_repositories, t.f_commits, t.f_technologies, t.f_occurrences, t.f_analysis_sessions)
    return out.select("repository_id", "name", "commits", "technologies", "occurrences", "latest_status")


@query("public_repositories", """
SELECT repository_id, name, analysis_count FROM f_repositories WHERE coalesce(is_public, true) AND repository_id IN (SELECT repository_id FROM f_repo_tags WHERE tag = 'building') AND primary_language = 'Java'
ORDER BY coalesce(analysis_count, 0) DESC, repository_id LIMIT 50""", REPOS)
def _(t):
    return repo.public_repositories(repositories(t), tag="building", language="Java").select("repository_id", "name", "analysis_count")


@query("with_user_flag", """
SELECT r.repository_id, u.access_type AS user_access_type, u.access_type IS NOT NULL AS user_has_repository FROM f_repositories r LEFT JOIN (SELECT * FROM f_user_repos WHERE user_id = '4') u USING (repository_id)""", REPOS)
def _(t):
    return repo.with_user_flag(t.f_repositories, t.f_user_repos, "4").select("repository_id", "user_access_type", "user_has_repository")


@query("not_owned", "SELECT repository_id FROM f_repositories WHERE repository_id NOT IN (SELECT repository_id FROM f_user_repos WHERE user_id = '4')", REPOS)
def _(t):
    return repo.not_owned(t.f_repositories, t.f_user_repos, "4").select("repository_id")


@query("user_repositories", "SELECT repository_id, name, access_type, last_seq FROM f_user_repos JOIN f_repositories USING (repository_id) WHERE user_id = '4'", REPOS)
def _(t):
    return repo.user_repositories_of(t.f_user_repos, t.f_repositories, "4").select("repository_id", "name", "access_type", "last_seq")


PREFS = """
WITH p AS (SELECT DISTINCT user_id, 'language' AS kind, primary_language AS value FROM f_user_repos JOIN f_repositories USING (repository_id) WHERE primary_language IS NOT NULL
 UNION ALL SELECT DISTINCT user_id, 'tag', tag FROM f_user_repos JOIN f_repo_tags USING (repository_id))
"""


@query("user_preferences", PREFS + "SELECT * FROM p", REPOS)
def _(t):
    return repo.user_preferences(t.f_user_repos, repositories(t))


@query("relevant_repositories", PREFS + """,
 s AS (SELECT r.*, coalesce(primary_language IN (SELECT value FROM p WHERE user_id = '4' AND kind = 'language'), false) AS lm, (SELECT count(*) FROM f_repo_tags g WHERE g.repository_id = r.repository_id AND tag IN (SELECT value FROM p WHERE user_id = '4' AND kind = 'tag')) AS st
  FROM f_repositories r WHERE repository_id NOT IN (SELECT repository_id FROM f_user_repos WHERE user_id = '4')),
 c AS (SELECT *, CASE WHEN lm THEN 3.0 ELSE 0.0 END + st * 1.5 + least(coalesce(analysis_count, 0) / 10, 2.0) + least(unique_users / 5, 1.0) AS score FROM s WHERE lm AND st > 0)
SELECT repository_id, round(score::DOUBLE, 9) AS relevance_score FROM c ORDER BY score DESC, repository_id LIMIT 20""", REPOS)
def _(t):
    out = repo.relevant_repositories("4", t.f_user_repos, repositories(t))
    return out.select("repository_id", F.round("relevance_score", 9).alias("relevance_score"))
