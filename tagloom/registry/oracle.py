"""SQL that gives the result of every registered query on the same tables.

The common table expressions below mirror the derived tables; a query names the
ones it needs and they are put in front of it with everything they build on.
"""

from __future__ import annotations

from tagloom.registry import queries as q
from tagloom.registry import views as v

# name -> (expressions it builds on, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), "SELECT lpad(doc_id::VARCHAR, 10, '0') AS id, text FROM documents"),
    "snip": ((), """
        SELECT lpad(d.doc_id::VARCHAR, 10, '0') AS id, d.lang AS title,
               d.source AS author, d.doc_id::INTEGER AS chapter_index,
               'doc://' || d.source || '/' || d.doc_id AS source_url,
               '2024-01-01 00:00:00' AS created_at,
               CASE WHEN l.quality = 0 THEN '[]'
                    WHEN l.quality = 1 THEN '[' || (l.toxic + 1) || ']' END AS tags
        FROM documents d LEFT JOIN labels l USING (doc_id)"""),
    "tok": (("docs",), r"""
        SELECT id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM docs"""),
    "prop": (("tok",), """
        SELECT id, idx, term AS name FROM (
          SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY hits DESC, term) AS idx
          FROM (SELECT id, term, count(*) AS hits FROM tok
                WHERE regexp_full_match(term, '[A-Za-z]{5,12}') GROUP BY id, term))
        WHERE idx <= 4"""),
    "backlog": (("snip",), "SELECT id FROM snip WHERE tags IS NULL OR tags = '[]'"),
    "vocab": (("prop", "snip"), f"""
        SELECT row_number() OVER (ORDER BY first) AS id, name, usage_count FROM (
          SELECT name, min(id || lpad(idx::VARCHAR, 3, '0')) AS first, count(*) AS usage_count
          FROM prop WHERE id IN (SELECT id FROM snip WHERE tags IS NOT NULL AND tags <> '[]')
          GROUP BY name)"""),
    "asg": (("prop", "vocab"), """
        SELECT p.id, p.idx, p.name, t.id AS tag_id
        FROM prop p JOIN vocab t ON lower(p.name) = lower(t.name)"""),
    "pairs": (("asg",), "SELECT DISTINCT id AS snippet_id, tag_id FROM asg"),
    "listed": (("snip", "asg"), """
        SELECT s.id, CASE WHEN s.tags IS NOT NULL THEN coalesce(a.list, '[]') END AS tags
        FROM snip s LEFT JOIN (
          SELECT id, '[' || string_agg(tag_id::VARCHAR, ',' ORDER BY idx) || ']' AS list
          FROM asg GROUP BY id) a USING (id)"""),
    "lexi": ((), r"""
        SELECT term, CASE WHEN length(term) <= 7 THEN 0 WHEN length(term) <= 9 THEN 1
                          ELSE 2 END AS facet
        FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term
              FROM benchmark)
        WHERE regexp_full_match(term, '[A-Za-z]{5,12}')"""),
    "lexprop": (("tok", "lexi"), """
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY facet, rn) AS idx, term AS name
        FROM (SELECT id, facet, term,
                     row_number() OVER (PARTITION BY id, facet ORDER BY count(*) DESC, term) AS rn
              FROM tok JOIN lexi USING (term) GROUP BY id, facet, term)
        WHERE rn <= 4"""),
    "reply": ((), """
        SELECT conv_id, turn, replace(text, ' ', chr(10)) AS reply FROM conversations"""),
    "msg": ((), """
        SELECT event_id, snippet_id, epoch_us(ts) // 1000 AS timestamp, 1 + k // 20 AS attempts,
               event_type = 'error' AS failed,
               CASE WHEN event_type <> 'error' THEN NULL
                    WHEN k < 15 THEN 'AiError 3040: Capacity temporarily exceeded'
                    WHEN k < 30 THEN 'HTTP 429'
                    WHEN k < 45 THEN 'request timeout'
                    WHEN k < 60 THEN 'upstream answered 503'
                    WHEN k < 75 THEN 'Snippet ' || snippet_id || ' not found'
                    WHEN k < 90 THEN 'unexpected reply' END AS error
        FROM (SELECT *, lpad(user_id::VARCHAR, 10, '0') AS snippet_id,
                     json_extract(props, '$.k')::BIGINT AS k FROM events)"""),
    "judged": (("msg",), """
        SELECT *, CASE WHEN NOT failed THEN 'ack' WHEN kind = 'missing' THEN 'ack'
                       WHEN attempts > 3 THEN 'dead_letter' ELSE 'retry' END AS action,
               CASE kind WHEN 'capacity' THEN list_extract([30, 60, 120, 240, 300], attempts::INT)
                         WHEN 'missing' THEN NULL ELSE 60 END::BIGINT AS delay
        FROM (SELECT *, CASE WHEN NOT failed THEN NULL WHEN error IS NULL THEN 'unknown'
                             WHEN error LIKE '%3040%' THEN 'capacity'
                             WHEN error LIKE '%429%' THEN 'rate_limit'
                             WHEN error LIKE '%timeout%' OR error LIKE '%503%' THEN 'transient'
                             WHEN error LIKE '%not found%' THEN 'missing'
                             ELSE 'other' END AS kind FROM msg)"""),
    "numbered": (("backlog",), """
        SELECT id, row_number() OVER (ORDER BY id) AS row_no FROM backlog"""),
    "queued": (("numbered",), """
        SELECT id, row_no, (row_no - 1) // 50 + 1 AS chunk, id IN (
          SELECT lpad(page_id::VARCHAR, 10, '0') FROM pages) AS ok
        FROM numbered"""),
    "stems": (("vocab",), """
        SELECT *, row_number() OVER (ORDER BY stem) AS reply_no,
               lead(lead_id) OVER (ORDER BY stem) AS next_lead
        FROM (SELECT stem, list_extract(ids, 1) AS lead_id, list_extract(names, 1) AS lead_name,
                     list_sort(list_slice(ids, 2, len(ids))) AS others
              FROM (SELECT substr(name, 1, 4) AS stem,
                           list(id ORDER BY usage_count DESC, id) AS ids,
                           list(name ORDER BY usage_count DESC, id) AS names
                    FROM vocab GROUP BY 1))"""),
    "planned": (("stems",), f"""
        SELECT reply_no, lead_id, lead_name, name, ids, reason,
               '{{"primary_tag_id": ' || lead_id || ', "primary_tag_name": "' || name
               || '", "merge_tag_ids": [' || array_to_string(ids, ', ') || '], "reason": "'
               || reason || '"' AS grp
        FROM (SELECT *, CASE n WHEN 1 THEN lead_name WHEN 2 THEN stem || '-1'
                               ELSE stem || 'ing' END AS name,
                     CASE n WHEN 3 THEN '' ELSE 'stem ' || stem END AS reason,
                     [lead_id] || others || [lead_id + {v.UNKNOWN_ID}] || CASE
                       WHEN n % 2 = 1 AND next_lead IS NOT NULL THEN [next_lead] ELSE [] END AS ids
              FROM (SELECT *, len(others) AS n FROM stems))"""),
    "planrep": (("planned",), """
        SELECT reply_no, CASE reply_no % 5
          WHEN 0 THEN '```json' || chr(10) || '{"consolidations": [' || grp || '}]}' || chr(10) || '```'
          WHEN 1 THEN 'Here is the plan: {"consolidations": [' || grp || '}]} Done.'
          WHEN 2 THEN '{"consolidations": [ // groups' || chr(10) || grp || ',}, ]}'
          WHEN 3 THEN '{"consolidations": /* by stem */ [' || grp || '}]}  '
          ELSE '{"consolidations": [' || grp END AS reply
        FROM planned"""),
    # only the last wrapping has no closing brace and is lost as a whole
    "mention": (("planned", "vocab"), """
        SELECT p.reply_no, p.lead_id AS primary_id, p.lead_name, p.name AS asked,
               CASE WHEN p.reason = '' THEN 'No reason provided' ELSE p.reason END AS reason,
               u.pos, u.merge_id
        FROM planned p, LATERAL (SELECT unnest(p.ids) AS merge_id,
                                        generate_subscripts(p.ids, 1) AS pos) u
        WHERE p.reply_no % 5 <> 4 AND u.merge_id IN (SELECT id FROM vocab)"""),
    "owner": (("mention",), """
        SELECT tag_id, min(place) AS place FROM (
          SELECT primary_id AS tag_id, reply_no * 100000 AS place FROM mention
          UNION ALL SELECT merge_id, reply_no * 100000 + pos FROM mention) GROUP BY tag_id"""),
    "verdicts": (("mention", "owner"), """
        SELECT m.*, CASE WHEN m.merge_id = m.primary_id THEN 'self merge'
                         WHEN op.place <> m.reply_no * 100000 THEN 'primary taken'
                         WHEN om.place <> m.reply_no * 100000 + m.pos THEN 'already named'
                         ELSE 'merge' END AS verdict
        FROM mention m JOIN owner op ON op.tag_id = m.primary_id
                       JOIN owner om ON om.tag_id = m.merge_id"""),
    "mapping": (("verdicts",), "SELECT * FROM verdicts WHERE verdict = 'merge'"),
    "final": (("backlog", "prop"), "SELECT * FROM prop WHERE id IN (SELECT id FROM backlog)"),
}

SIMILAR = "1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))"


def similar(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE {SIMILAR.format(a=a, b=b)} END"


def growth(source: str, existing: str, theta: float = 0.8) -> str:
    """Leaders of a proposal table, one name after the other in order.

    Gives ``fresh(r, name, first)`` and ``walk`` whose last row has all leaders.
    Names without an earlier similar name lead from the start.
    """
    near = f"{similar('f.name', 't.name')} >= {theta}"
    return f"""
      firsts AS (SELECT name, min(id || lpad(idx::VARCHAR, 3, '0')) AS first
                 FROM {source} GROUP BY name),
      fresh AS MATERIALIZED (
        SELECT name, first, row_number() OVER (ORDER BY first) AS r FROM firsts f
        WHERE NOT EXISTS (SELECT 1 FROM {existing} t WHERE {near})),
      closes AS MATERIALIZED (
        SELECT f.r, list(t.r) AS earlier, row_number() OVER (ORDER BY f.r) AS step
        FROM fresh f JOIN fresh t ON t.r < f.r AND {near} GROUP BY f.r),
      walk(step, leaders) AS (
        SELECT 0::BIGINT, (SELECT coalesce(list(r), []) FROM fresh
                           WHERE r NOT IN (SELECT r FROM closes))
        UNION ALL
        SELECT w.step + 1, CASE WHEN list_has_any(c.earlier, w.leaders) THEN w.leaders
                                ELSE list_append(w.leaders, c.r) END
        FROM walk w JOIN closes c ON c.step = w.step + 1),
      leaders AS MATERIALIZED (
        SELECT f.name, f.first, row_number() OVER (ORDER BY f.first) AS n
        FROM fresh f WHERE f.r IN (
          SELECT unnest(leaders) FROM walk WHERE step = (SELECT max(step) FROM walk)))"""


def assignment(source: str, existing: str) -> str:
    """``given``: the best tag of every proposal among tags born by then."""
    near = similar("o.name", "t.name")
    return f"""
      alltags AS MATERIALIZED (
        SELECT id AS tag_id, name, '' AS born FROM {existing} UNION ALL
        SELECT n + (SELECT count(*) FROM {existing}), name, first FROM kept),
      near AS MATERIALIZED (
        SELECT o.name, t.tag_id, t.born, {near} AS sim
        FROM (SELECT DISTINCT name FROM {source}) o JOIN alltags t ON {near} >= 0.8),
      given AS MATERIALIZED (
        SELECT id, idx, name, tag_id, sim, born = here AS is_new FROM (
          SELECT p.*, c.tag_id, c.sim, c.born, p.id || lpad(p.idx::VARCHAR, 3, '0') AS here,
                 row_number() OVER (PARTITION BY p.id, p.idx ORDER BY c.sim DESC, c.tag_id) AS best
          FROM {source} p JOIN near c ON c.name = p.name
          WHERE c.born <= p.id || lpad(p.idx::VARCHAR, 3, '0')) WHERE best = 1)"""


def kept(existing: str, cap: int = q.ROOM) -> str:
    return f"""
      kept AS (SELECT * FROM leaders WHERE n <= {cap} - (SELECT count(*) FROM {existing}))"""


def stars(edges: str, reason: str) -> str:
    """Star groups from ``edges(a, b, similarity)`` over ``vocab``."""
    return f"""
      ranked AS MATERIALIZED (
        SELECT id, name, row_number() OVER (ORDER BY usage_count DESC, id) AS r FROM vocab),
      pairwise AS MATERIALIZED ({edges}),
      directed AS MATERIALIZED (
        SELECT least(x.r, y.r) AS lo, greatest(x.r, y.r) AS hi, e.similarity
        FROM pairwise e JOIN ranked x ON x.id = e.a JOIN ranked y ON y.id = e.b),
      closes AS MATERIALIZED (
        SELECT hi AS r, list(lo) AS earlier, row_number() OVER (ORDER BY hi) AS step
        FROM directed GROUP BY hi),
      walk(step, leaders) AS (
        SELECT 0::BIGINT, (SELECT list(r) FROM ranked WHERE r NOT IN (SELECT r FROM closes))
        UNION ALL
        SELECT w.step + 1, CASE WHEN list_has_any(c.earlier, w.leaders) THEN w.leaders
                                ELSE list_append(w.leaders, c.r) END
        FROM walk w JOIN closes c ON c.step = w.step + 1),
      heads AS MATERIALIZED (
        SELECT unnest(leaders) AS r FROM walk WHERE step = (SELECT max(step) FROM walk)),
      joined AS (
        SELECT hi, lo, similarity FROM (
          SELECT d.*, row_number() OVER (PARTITION BY hi ORDER BY similarity DESC, lo) AS best
          FROM directed d WHERE lo IN (SELECT r FROM heads) AND hi NOT IN (SELECT r FROM heads))
        WHERE best = 1),
      placed AS (
        SELECT *, row_number() OVER (PARTITION BY lo ORDER BY similarity DESC, hi) AS pos
        FROM joined)
      SELECT p.id AS primary_id, p.name AS primary_name, j.pos, m.id AS merge_id,
             '{reason}' AS reason
      FROM placed j JOIN ranked p ON p.r = j.lo JOIN ranked m ON m.r = j.hi
      WHERE j.pos <= 10"""


def with_ctes(names: str, sql: str, recursive: bool = False) -> str:
    """``sql`` behind the named expressions and all they build on."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in wanted)
    start = "WITH RECURSIVE" if recursive else "WITH"
    joint = "" if sql.lstrip().upper().startswith("SELECT") else ","
    return f"{start} {head}{joint} {sql}"


# white space and tag shapes as the SQL regular expressions spell them
SPACE = (
    r"\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
CJK_DROPPED = r"[^\x{0030}-\x{3134}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
CJK_VALID = r"[\x{4e00}-\x{9fff}]{2}"


def packed(column: str, dropped: str) -> str:
    return (
        f"regexp_replace(regexp_replace({column}, '[{SPACE}]+', '', 'g'), "
        f"'{dropped}', '', 'g')"
    )


def parsed(reply: str) -> str:
    """List of valid tags of the first four usable lines of a reply."""
    trimmed = f"list_transform(string_split({reply}, chr(10)), lambda s: " \
        f"regexp_replace(s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))"
    usable = f"list_filter({trimmed}, lambda s: s <> '' AND NOT contains(s, ':') AND s <> 'none')"
    cleaned = f"list_transform(list_slice({usable}, 1, 4), lambda s: {packed('s', '[^A-Za-z]')})"
    return f"list_filter({cleaned}, lambda s: regexp_full_match(s, '[A-Za-z]{{5,12}}'))"


def distinct_first(items: str) -> str:
    """Distinct items of a list in order of first place."""
    return (
        f"list_transform(list_filter(list_transform({items}, "
        f"lambda s, i: {{'s': s, 'i': i, 'p': list_position({items}, s)}}), "
        "lambda e: e.i = e.p), lambda e: e.s)"
    )


EXTRACTED = rf"""
    SELECT reply_no, CASE WHEN fenced <> '' THEN fenced WHEN bare <> '' THEN bare END AS json
    FROM (SELECT reply_no,
                 regexp_extract(reply, '```(?:json)?\s*(\{{[\s\S]*?\}})\s*```', 1) AS fenced,
                 regexp_extract(reply, '(\{{[\s\S]*\}})', 1) AS bare FROM planrep)"""
SCRUBBED = rf"""
    SELECT reply_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      json, '//[^\n\r]*', '', 'g'), '/\*[\s\S]*?\*/', '', 'g'),
      ',(\s*[}}\]])', '\1', 'g'), ',\s*$', '', 'g'), E' \t\n\r') AS json
    FROM ({EXTRACTED})"""

NEW_TAGS = """
    SELECT n + {mark} AS id, name, left(first, 10) AS born_id,
           right(first, 3)::BIGINT AS born_idx FROM kept"""
COUNT_VOCAB = "(SELECT count(*) FROM vocab)"


def oracle_sql() -> dict[str, str]:
    grown = growth("final", "vocab")
    final = f"{grown}, {kept('vocab')}, {assignment('final', 'vocab')}"
    page = q.PAGE
    return {
        "scan_snippets": with_ctes("snip", "SELECT * FROM snip"),
        "scan_vocab": with_ctes("vocab", "SELECT id, name, usage_count FROM vocab"),
        "scan_junction": with_ctes("pairs", "SELECT snippet_id, tag_id FROM pairs"),
        "content_join": with_ctes("snip", """
            SELECT s.id, s.title, p.html AS text
            FROM snip s JOIN pages p ON lpad(p.page_id::VARCHAR, 10, '0') = s.id"""),
        "missing_content_errors": with_ctes("snip", """
            SELECT id, message, 'Snippet ' || id || ': ' || message AS error FROM (
              SELECT e.id, CASE WHEN s.id IS NULL THEN 'Snippet ' || e.id || ' not found'
                 WHEN p.page_id IS NULL
                 THEN 'Content for snippet ' || e.id || ' not found in content store' END AS message
              FROM (SELECT DISTINCT lpad(event_id::VARCHAR, 10, '0') AS id FROM events) e
              LEFT JOIN snip s ON s.id = e.id
              LEFT JOIN pages p ON lpad(p.page_id::VARCHAR, 10, '0') = e.id)
            WHERE message IS NOT NULL"""),
        "init_schema": """
            SELECT 'snippets' AS table_name, count(*) AS n_rows FROM documents
            UNION ALL SELECT 'tags', 0 UNION ALL SELECT 'snippet_tags', 0""",
        "publish_roundtrip": with_ctes("snip", """
            SELECT id, author, coalesce(tags, '[]') AS tags FROM snip"""),
        "integrity_audit": with_ctes("snip vocab", """
            SELECT * FROM (
            WITH p AS (SELECT lpad(user_id::VARCHAR, 10, '0') AS snippet_id,
                              json_extract(props, '$.k')::BIGINT AS tag_id FROM events)
            SELECT 'snippet id unique' AS rule, count(*) - count(DISTINCT id) AS n_keys,
                   count(*) - count(DISTINCT id) AS n_rows FROM snip
            UNION ALL SELECT 'tag id unique', count(*) - count(DISTINCT id),
                   count(*) - count(DISTINCT id) FROM vocab
            UNION ALL SELECT 'tag name unique', count(*) - count(DISTINCT name),
                   count(*) - count(DISTINCT name) FROM vocab
            UNION ALL SELECT 'pair unique', count(*), coalesce(sum(n - 1), 0)::BIGINT FROM (
                   SELECT count(*) AS n FROM p GROUP BY snippet_id, tag_id HAVING count(*) > 1)
            UNION ALL SELECT 'pair has snippet', count(DISTINCT snippet_id), count(*) FROM p
                   WHERE snippet_id NOT IN (SELECT id FROM snip)
            UNION ALL SELECT 'pair has tag', count(DISTINCT tag_id), count(*) FROM p
                   WHERE tag_id NOT IN (SELECT id FROM vocab))"""),
        "stream_source": with_ctes("msg", """
            SELECT snippet_id, count(*) AS n_messages, max(timestamp) AS last_timestamp,
                   max(attempts) AS most_attempts FROM msg GROUP BY snippet_id"""),
        "delete_cascade": with_ctes("pairs vocab snip docs", """
            SELECT p.snippet_id, t.id AS tag_id, t.usage_count, s.author
            FROM (SELECT * FROM vocab WHERE usage_count <> 1) t LEFT JOIN (
              SELECT * FROM pairs
              WHERE snippet_id NOT IN (SELECT id FROM docs WHERE length(text) < 500)
            ) p ON p.tag_id = t.id
            LEFT JOIN snip s ON s.id = p.snippet_id"""),
        "enqueue_messages": with_ctes("backlog", """
            SELECT id AS snippet_id, 1704067200000::BIGINT AS timestamp,
                   'medium' AS priority, 1::BIGINT AS attempts FROM backlog"""),
        "tags_json_roundtrip": with_ctes("listed", """
            SELECT id, CASE WHEN tags <> '[]' THEN tags END AS json,
                   CASE WHEN tags <> '[]' THEN replace(replace(tags, '[', ''), ']', '') END AS ids,
                   coalesce(tags = '[]', false) AS corrupt FROM listed"""),
        "untagged": with_ctes("snip", "SELECT id, tags FROM snip WHERE tags IS NULL OR tags = '[]'"),
        "tagged": with_ctes(
            "snip", "SELECT id, tags FROM snip WHERE tags IS NOT NULL AND tags <> '[]'"),
        "point_lookup": with_ctes(
            "snip", f"SELECT id, title, author, tags FROM snip WHERE id = '{q.POINT}'"),
        "keyset_filter": with_ctes(
            "snip", f"SELECT id, tags FROM snip WHERE id > '{q.CURSOR}'"),
        "keyset_page": with_ctes("backlog", f"""
            SELECT max(id) AS next_cursor, count(*) AS n_rows, {page}::BIGINT AS batch_size
            FROM (SELECT id FROM backlog WHERE id > '{q.CURSOR}' ORDER BY id LIMIT {page})"""),
        "offset_page": with_ctes(
            "backlog", f"SELECT id FROM backlog ORDER BY id LIMIT 50 OFFSET {q.OFFSET}"),
        "chunk_plan": with_ctes("queued", """
            SELECT chunk, min(id) AS first_id, max(id) AS last_id, count(*) AS n_rows
            FROM queued GROUP BY chunk"""),
        "tags_listing": with_ctes("vocab", """
            SELECT id, name, '2024-01-01 00:00:00' AS created_at, usage_count
            FROM vocab ORDER BY usage_count DESC, id"""),
        "top_n_per_doc": with_ctes("prop", "SELECT id, idx, name FROM prop"),
        "fixed_batches": with_ctes("numbered", """
            SELECT (row_no - 1) // 10 + 1 AS batch, string_agg(id, ',' ORDER BY id) AS ids
            FROM numbered GROUP BY 1"""),
        "status": with_ctes("snip vocab", """
            SELECT count(*) AS total_snippets, (SELECT count(*) FROM vocab) AS total_tags,
                   count(*) FILTER (tags <> '[]') AS tagged_snippets,
                   count(*) FILTER (tags IS NULL OR tags = '[]') AS untagged_snippets,
                   'active' AS status FROM snip"""),
        "queue_status": with_ctes("snip vocab", """
            SELECT total_snippets, total_tags, tagged_snippets, pending_snippets,
                   round(tagged_snippets / total_snippets * 100, 1) AS percent,
                   CASE WHEN pending_snippets > 0 THEN 'processing' ELSE 'idle' END AS status,
                   (CASE WHEN pending_snippets > 0 THEN 1 ELSE 0 END
                    + CASE WHEN total_tags = 0 THEN 1 ELSE 0 END)::BIGINT AS n_hints
            FROM (SELECT count(*) AS total_snippets, (SELECT count(*) FROM vocab) AS total_tags,
                         count(*) FILTER (tags <> '[]') AS tagged_snippets,
                         count(*) FILTER (tags IS NULL OR tags = '[]') AS pending_snippets
                  FROM snip)"""),
        "usage_counts": with_ctes("vocab asg", """
            SELECT v.id, v.name, v.usage_count + coalesce(a.n, 0) AS usage_count
            FROM vocab v LEFT JOIN (SELECT tag_id, count(*) AS n FROM asg GROUP BY 1) a
              ON a.tag_id = v.id"""),
        "clear_summary": with_ctes("snip vocab", """
            SELECT (SELECT count(*) FROM vocab) AS total_tags,
                   count(*) FILTER (tags <> '[]') AS tagged_snippets,
                   count(*) AS total_snippets FROM snip"""),
        "usage_drift": with_ctes("vocab pairs", """
            SELECT id, coalesce(usage_count, 0) AS stored, coalesce(n, 0) AS held_by,
                   coalesce(usage_count, 0) - coalesce(n, 0) AS drift
            FROM vocab FULL JOIN (SELECT tag_id AS id, count(*) AS n FROM pairs GROUP BY 1)
            USING (id)"""),
        "run_stats": with_ctes("queued asg", """
            SELECT count(*) FILTER (ok) AS processed_snippets, 0::BIGINT AS new_tags_created,
                   coalesce(sum(n) FILTER (ok), 0)::BIGINT AS existing_tags_used,
                   count(*) FILTER (NOT ok) AS n_errors, max(id) AS last_processed_id
            FROM queued LEFT JOIN (SELECT id, count(*) AS n FROM asg GROUP BY 1) USING (id)"""),
        "chunk_totals": with_ctes("queued", """
            SELECT chunk, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed
            FROM queued GROUP BY chunk"""),
        "exact_match_tags": with_ctes("asg", """
            SELECT id, idx, upper(name[1]) || name[2:] AS name, tag_id FROM asg"""),
        "fuzzy_name_pairs": with_ctes("prop vocab", f"""
            SELECT o.name AS left_name, t.name AS right_name,
                   round({similar('o.name', 't.name')}, 6) AS similarity
            FROM (SELECT DISTINCT name FROM prop) o
            JOIN vocab t ON {similar('o.name', 't.name')} >= 0.8"""),
        "best_match_tags": with_ctes("prop vocab", f"""
            SELECT left_name, tag_id, round(sim, 6) AS similarity FROM (
              SELECT o.name AS left_name, t.id AS tag_id, {similar('o.name', 't.name')} AS sim,
                     row_number() OVER (PARTITION BY o.name
                       ORDER BY {similar('o.name', 't.name')} DESC, t.id) AS best
              FROM (SELECT DISTINCT name FROM prop) o
              JOIN vocab t ON {similar('o.name', 't.name')} >= 0.8)
            WHERE best = 1"""),
        "snippets_with_any_tag": with_ctes("snip pairs vocab", """
            SELECT id FROM snip WHERE id IN (
              SELECT snippet_id FROM pairs p JOIN vocab v ON v.id = p.tag_id
              WHERE v.usage_count > 1)"""),
        "insert_ignore": with_ctes("snip pairs", """
            SELECT snippet_id, tag_id FROM pairs UNION
            SELECT id, replace(replace(tags, '[', ''), ']', '')::BIGINT FROM snip
            WHERE tags <> '[]'"""),
        "truncate_texts": with_ctes("docs", """
            SELECT id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...'
                            ELSE text END AS shown FROM docs"""),
        "facet_prompt_texts": with_ctes("docs", """
            SELECT id, facet, word || ' words of this text:' || chr(10) || CASE
                     WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...'
                     ELSE text END AS prompt
            FROM docs, (VALUES (0::BIGINT, 'Short'), (1, 'Middle'), (2, 'Long')) f(facet, word)"""),
        "model_hook": with_ctes("docs", """
            SELECT id, facet,
                   CASE WHEN prompt NOT LIKE '%...' THEN
                     length(prompt) || chr(10) || left(prompt, 5) END AS reply,
                   CASE WHEN prompt LIKE '%...' THEN 'timeout while reading a long text' END AS error
            FROM (SELECT id, facet, word || ' words of this text:' || chr(10) || CASE
                           WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...'
                           ELSE text END AS prompt
                  FROM docs, (VALUES (0::BIGINT, 'Short'), (1, 'Middle'), (2, 'Long')) f(facet, word))"""),
        "lexicon_proposals": with_ctes("lexprop", """
            SELECT id, string_agg(name, ',' ORDER BY idx) AS names FROM lexprop GROUP BY id"""),
        "parse_replies": with_ctes("reply", f"""
            SELECT conv_id, turn, array_to_string({parsed('reply')}, ',') AS names FROM reply"""),
        "clean_tags": f"""
            SELECT conv_id, turn, pos, {packed('line', '[^A-Za-z]')} AS word,
                   {packed('line', CJK_DROPPED)} AS cjk2
            FROM (SELECT conv_id, turn, unnest(lines) AS line,
                         generate_subscripts(lines, 1) - 1 AS pos
                  FROM (SELECT *, string_split(text, chr(10)) AS lines FROM conversations))""",
        "valid_tags": with_ctes("reply", f"""
            SELECT conv_id, turn, count(*) AS n_lines,
                   count(*) FILTER (regexp_full_match({packed('line', '[^A-Za-z]')},
                                                      '[A-Za-z]{{5,12}}')) AS n_word,
                   count(*) FILTER (regexp_full_match({packed('line', CJK_DROPPED)},
                                                      '{CJK_VALID}')) AS n_cjk2
            FROM (SELECT conv_id, turn, unnest(string_split(reply, chr(10))) AS line FROM reply)
            GROUP BY conv_id, turn"""),
        "combine_facets": with_ctes("reply", f"""
            SELECT conv_id, turn,
                   array_to_string(list_slice({distinct_first('tags')}, 1, 12), ',') AS names
            FROM (SELECT conv_id, turn, {parsed('reply')} || {parsed('lower(reply)')} || {parsed(
                "array_to_string(list_reverse(string_split(reply, chr(10))), chr(10))"
            )} AS tags FROM reply)"""),
        "edit_distance": with_ctes("prop", """
            SELECT id, idx, levenshtein(name, other) AS distance
            FROM (SELECT *, lead(name) OVER (PARTITION BY id ORDER BY idx) AS other FROM prop)
            WHERE other IS NOT NULL"""),
        "text_similarity": with_ctes("prop", f"""
            SELECT id, idx, round({similar('name', 'other')}, 6) AS similarity
            FROM (SELECT *, lead(name) OVER (PARTITION BY id ORDER BY idx) AS other FROM prop)
            WHERE other IS NOT NULL"""),
        "grow_vocab": with_ctes(
            "final vocab",
            f"{grown}, {kept('vocab')} {NEW_TAGS.format(mark=COUNT_VOCAB)}", True),
        "vocab_cap": with_ctes(
            "final vocab",
            f"{grown}, {kept('vocab', q.SMALL_CAP)} {NEW_TAGS.format(mark=COUNT_VOCAB)}", True),
        "allocate_ids": with_ctes("final", f"""
            SELECT {v.UNKNOWN_ID} + row_number() OVER (ORDER BY first) AS id, name,
                   left(first, 10) AS born_id, right(first, 3)::BIGINT AS born_idx
            FROM (SELECT name, min(id || lpad(idx::VARCHAR, 3, '0')) AS first
                  FROM final GROUP BY name ORDER BY first LIMIT {q.ROOM})"""),
        "assign_tags_to_proposals": with_ctes("final vocab", f"""{final}
            SELECT id, idx, tag_id, round(sim, 6) AS similarity, is_new FROM given""", True),
        "snippet_tag_arrays": with_ctes("final vocab", f"""{final}
            SELECT b.id, coalesce('[' || string_agg(g.tag_id::VARCHAR, ',' ORDER BY g.idx) || ']',
                                  '[]') AS tags
            FROM backlog b LEFT JOIN given g USING (id) GROUP BY b.id""", True),
        "replace_junction": with_ctes("final vocab pairs", f"""{final}
            SELECT snippet_id, tag_id FROM pairs
            WHERE snippet_id NOT IN (SELECT id FROM backlog)
            UNION SELECT id, tag_id FROM given""", True),
        "tag_backlog": with_ctes("lexprop backlog", f"""
            source AS MATERIALIZED (
              SELECT * FROM lexprop WHERE id IN (SELECT id FROM backlog)),
            none AS (SELECT 0::BIGINT AS id, '' AS name WHERE false),
            {growth('source', 'none')}, {kept('none')}, {assignment('source', 'none')}
            SELECT k.n AS id, k.name, count(g.id) AS usage_count
            FROM kept k LEFT JOIN given g ON g.tag_id = k.n GROUP BY k.n, k.name""", True),
        "planner_input": with_ctes("vocab", """
            SELECT count(*) AS n_tags,
                   string_agg(id || ':' || name || ' (' || usage_count || ')', chr(10)
                              ORDER BY usage_count DESC, id) AS tag_list FROM vocab"""),
        "extract_json": with_ctes("planrep", EXTRACTED.strip()),
        "scrub_json": with_ctes("planrep", SCRUBBED.strip()),
        "parse_plan": with_ctes("planrep", f"""
            SELECT reply_no, g.pos - 1 AS group_no, g.c.primary_tag_id::BIGINT AS primary_id,
                   g.c.primary_tag_name AS primary_tag_name,
                   array_to_string(g.c.merge_tag_ids::BIGINT[], ',') AS merge_ids,
                   g.c.reason AS reason
            FROM (SELECT reply_no, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos
                  FROM (SELECT reply_no, from_json(json_extract(json, '$.consolidations'),
                     '[{{"primary_tag_id":"DOUBLE","primary_tag_name":"VARCHAR",'
                     || '"merge_tag_ids":["DOUBLE"],"reason":"VARCHAR"}}]') AS cs
                        FROM ({SCRUBBED}) WHERE json_valid(json))) g"""),
        "plan_resolve": with_ctes(
            "mention", "SELECT reply_no, primary_id, pos, merge_id FROM mention"),
        "valid_groups": with_ctes("verdicts", """
            SELECT reply_no, primary_id, CASE WHEN asked <> lead_name THEN asked END
                     AS suggested_name, reason, pos, merge_id, verdict FROM verdicts"""),
        "rename_primary_tags": with_ctes("mapping vocab", r"""
            asks AS (SELECT DISTINCT reply_no, primary_id, lead_name, asked AS suggested_name,
                            regexp_replace(asked, '[^A-Za-z]', '', 'g') AS new_name
                     FROM mapping WHERE asked <> lead_name),
            seen AS (SELECT a.*, CASE
                WHEN NOT regexp_full_match(new_name, '[A-Za-z]{5,12}') THEN 'invalid name'
                WHEN EXISTS (SELECT 1 FROM vocab v WHERE v.name = a.new_name
                             AND v.id = a.primary_id) THEN 'unchanged'
                WHEN EXISTS (SELECT 1 FROM vocab v WHERE v.name = a.new_name) THEN 'name in use'
                WHEN reply_no > min(reply_no) OVER (PARTITION BY new_name) THEN 'name in use'
                ELSE 'rename' END AS verdict FROM asks a)
            SELECT reply_no, primary_id, suggested_name, new_name, verdict,
                   CASE WHEN verdict = 'rename' THEN new_name ELSE lead_name END AS name
            FROM seen"""),
        "remap_junction": with_ctes("mapping pairs", """
            SELECT DISTINCT snippet_id, coalesce(m.primary_id, p.tag_id) AS tag_id
            FROM pairs p LEFT JOIN mapping m ON m.merge_id = p.tag_id"""),
        "rewrite_arrays": with_ctes("mapping pairs listed", """
            elems AS (
              SELECT id, unnest(string_split(replace(replace(tags, '[', ''), ']', ''), ','))
                       AS item, generate_subscripts(string_split(
                       replace(replace(tags, '[', ''), ']', ''), ','), 1) AS pos
              FROM listed WHERE tags <> '[]'),
            present AS (SELECT id, item::BIGINT AS tag_id, pos FROM elems),
            changes AS (
              SELECT p.snippet_id AS id, m.merge_id, m.primary_id,
                     m.reply_no * 100000 + m.pos AS place
              FROM pairs p JOIN mapping m ON m.merge_id = p.tag_id),
            rows AS (
              SELECT id, tag_id, pos::BIGINT AS place FROM present x
              WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.id = x.id AND c.merge_id = x.tag_id)
              UNION ALL
              SELECT id, primary_id, 1000000 + min(place) FROM changes c
              WHERE id IN (SELECT id FROM listed WHERE tags IS NOT NULL)
                AND NOT EXISTS (SELECT 1 FROM present x WHERE x.id = c.id AND x.tag_id = c.primary_id)
              GROUP BY id, primary_id)
            SELECT l.id, CASE WHEN l.tags IS NOT NULL THEN coalesce(
                     '[' || string_agg(r.tag_id::VARCHAR, ',' ORDER BY r.place) || ']', '[]') END AS tags
            FROM listed l LEFT JOIN rows r USING (id) GROUP BY l.id, l.tags"""),
        "rollup_usage": with_ctes("mapping vocab", """
            SELECT v.id, v.name, (v.usage_count + coalesce(g.gain, 0))::BIGINT AS usage_count
            FROM vocab v LEFT JOIN (
              SELECT m.primary_id, sum(x.usage_count) AS gain
              FROM mapping m JOIN vocab x ON x.id = m.merge_id GROUP BY 1) g
              ON g.primary_id = v.id
            WHERE v.id NOT IN (SELECT merge_id FROM mapping)"""),
        "consolidation_report": with_ctes("mapping pairs listed", """
            SELECT m.reply_no, m.primary_id, m.merged_ids, coalesce(u.n, 0) AS snippets_updated,
                   m.reason
            FROM (SELECT reply_no, primary_id, reason,
                         string_agg(merge_id::VARCHAR, ',' ORDER BY pos) AS merged_ids
                  FROM mapping GROUP BY ALL) m
            LEFT JOIN (SELECT x.reply_no, count(*) AS n
                       FROM mapping x JOIN pairs p ON p.tag_id = x.merge_id
                       JOIN listed l ON l.id = p.snippet_id AND l.tags IS NOT NULL
                       GROUP BY 1) u USING (reply_no)"""),
        "dry_run": with_ctes("mapping vocab", """
            SELECT v.id, v.name, v.usage_count, m.primary_id
            FROM vocab v LEFT JOIN mapping m ON m.merge_id = v.id"""),
        "plan_edit": with_ctes("vocab", stars(f"""
            SELECT x.id AS a, y.id AS b, {similar('x.name', 'y.name')} AS similarity
            FROM vocab x JOIN vocab y ON x.id < y.id AND {similar('x.name', 'y.name')} >= 0.75""",
            "similar names"), True),
        "plan_cosine": with_ctes("vocab", stars(f"""
            SELECT * FROM (
              SELECT x.id AS a, y.id AS b,
                     round(list_cosine_similarity(x.e, y.e), 6) AS similarity
              FROM (SELECT vec_id + 1 AS id, embedding::DOUBLE[] AS e FROM embeddings) x
              JOIN (SELECT vec_id + 1 AS id, embedding::DOUBLE[] AS e FROM embeddings) y
                ON x.id < y.id)
            WHERE similarity >= {q.COSINE}
              AND a IN (SELECT id FROM vocab) AND b IN (SELECT id FROM vocab)""",
            "similar vectors"), True),
        "plan_jaccard": with_ctes("vocab pairs", stars(f"""
            SELECT a, b, n / (x.m + y.m - n) AS similarity
            FROM (SELECT p.tag_id AS a, r.tag_id AS b, count(*) AS n
                  FROM pairs p JOIN pairs r ON r.snippet_id = p.snippet_id AND p.tag_id < r.tag_id
                  GROUP BY 1, 2)
            JOIN (SELECT tag_id, count(*) AS m FROM pairs GROUP BY 1) x ON x.tag_id = a
            JOIN (SELECT tag_id, count(*) AS m FROM pairs GROUP BY 1) y ON y.tag_id = b
            WHERE n / (x.m + y.m - n) >= {q.JACCARD}""", "used together"), True),
        "classify_errors": with_ctes("judged", """
            SELECT event_id, kind, CASE WHEN kind = 'missing' THEN 'ack' ELSE 'retry' END AS action,
                   delay AS delay_seconds FROM judged WHERE failed"""),
        "backoff": with_ctes("msg", """
            SELECT event_id, least(300, 30 * power(2, attempts - 1))::BIGINT AS delay_seconds
            FROM msg"""),
        "retry_routing": with_ctes("judged", """
            SELECT event_id, action, CASE WHEN action = 'retry' THEN delay END AS delay_seconds,
                   CASE WHEN action = 'retry' THEN timestamp + delay * 1000 END AS next_at
            FROM judged"""),
        "dead_letter_messages": with_ctes("judged", """
            SELECT event_id, snippet_id, error, attempts FROM judged
            WHERE action = 'dead_letter'"""),
        "due_retries": with_ctes("judged", """
            SELECT snippet_id, 1704153600000::BIGINT AS timestamp, attempts + 1 AS attempts,
                   count(*) AS n_messages
            FROM judged WHERE action = 'retry' AND timestamp + delay * 1000 <= 1704153600000
            GROUP BY 1, 2, 3"""),
        "queue_rounds": with_ctes("judged", f"""
            SELECT snippet_id, run, CASE WHEN tries THEN 4 ELSE 1 END::BIGINT AS attempts,
                   tries AS dead
            FROM (SELECT m.snippet_id, coalesce(f.action <> 'ack', false) AS tries
                  FROM (SELECT DISTINCT snippet_id FROM judged) m LEFT JOIN (
                    SELECT snippet_id, arg_min(action, event_id) AS action
                    FROM judged WHERE failed GROUP BY snippet_id) f USING (snippet_id)),
                 (VALUES ({q.ROUNDS[0]}::BIGINT), ({q.ROUNDS[1]}::BIGINT)) AS r(run)"""),
        "queue_progress": with_ctes("queued", """
            SELECT count(*) AS total, count(*) FILTER (ok) AS queued,
                   count(*) FILTER (NOT ok) AS failed, 'completed' AS status,
                   50::BIGINT AS chunk_size, max(chunk) + 1 AS current_chunk,
                   max(chunk) AS total_chunks, max(chunk) AS processed_chunks,
                   max(id) FILTER (ok) AS last_processed_id,
                   max(id) FILTER (ok) AS resume_from_id FROM queued"""),
        "requeue_backlog": with_ctes("backlog msg", f"""
            SELECT id FROM backlog WHERE id > '{q.CURSOR}'
              AND id NOT IN (SELECT snippet_id FROM msg WHERE NOT failed)"""),
        "stream_tagging": with_ctes("prop vocab msg", f"""
            source AS MATERIALIZED (
              SELECT * FROM prop WHERE id IN (SELECT snippet_id FROM msg)),
            {growth('source', 'vocab')}, {kept('vocab')}, {assignment('source', 'vocab')}
            SELECT DISTINCT g.id AS snippet_id, g.tag_id, t.name
            FROM given g JOIN alltags t USING (tag_id)""", True),
        "clear_all_tags": with_ctes("listed vocab", """
            SELECT 'before' AS moment, (SELECT count(*) FROM vocab) AS total_tags,
                   count(*) FILTER (tags <> '[]') AS tagged_snippets,
                   count(*) AS total_snippets FROM listed
            UNION ALL SELECT 'after', 0, 0, count(*) FROM listed"""),
    }
