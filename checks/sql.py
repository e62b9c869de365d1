"""Shared pieces of the checking SQL: the model tables as CTEs, and number rules."""

CTES = {
    "comments": """SELECT CAST(d.doc_id AS VARCHAR) AS comment_id, d.source AS dataset_id,
        CAST(d.doc_id AS VARCHAR) AS source_id, d.text,
        CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'unannotated' END AS sentiment,
        d.lang AS "type",
        CASE WHEN l.quality IS NULL THEN 'pending' ELSE 'annotated' END AS status,
        CASE WHEN l.toxic = 1 THEN CAST(d.doc_id % 5 AS VARCHAR) END AS assigned_to,
        CASE WHEN l.quality IS NOT NULL THEN CAST(d.doc_id % 7 AS VARCHAR) END AS annotated_by,
        CASE WHEN l.quality IS NOT NULL THEN 1704069000 + d.doc_id * 60 END AS annotated_s,
        1704067200 + d.doc_id * 60 AS created_s
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "ev": """SELECT event_id, ts, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d') AS day,
        CAST(user_id AS VARCHAR) AS user_id, event_type, value,
        json_extract_string(props, '$.k') AS k FROM events""",
    "versions": """SELECT k AS comment_id, event_id AS version, ts, day, user_id,
        CASE WHEN event_type = 'purchase' THEN 'negative'
             WHEN event_type IN ('click', 'signup') THEN 'positive' ELSE 'unannotated' END AS sentiment,
        CASE WHEN value >= 10 THEN 'en' ELSE 'fr' END AS "type",
        CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN 'annotated' ELSE 'pending' END AS status,
        CASE WHEN event_type = 'signup' THEN 'signed' END AS note,
        'text ' || event_id AS text FROM ev""",
    "ds": """SELECT source AS dataset_id, 'Dataset ' || source AS name, COUNT(*) AS total_rows,
        CAST(substr(source, 4) AS INT) AS n,
        CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing'
             WHEN 2 THEN 'pending' ELSE 'failed' END AS status,
        CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'tx' || CAST(substr(source, 4) AS INT) END AS taxonomy_id,
        CAST(CAST(substr(source, 4) AS INT) % 3 AS VARCHAR) AS uploaded_by,
        CAST(CAST(substr(source, 4) AS INT) % 5 AS VARCHAR) AS assigned_to,
        1704067200 + min(doc_id) * 60 AS created_s, 1704067200 + max(doc_id) * 60 AS updated_s
        FROM documents GROUP BY source""",
    "terms": """SELECT 'tx' || n AS taxonomy_id, n, axis, value,
        row_number() OVER (PARTITION BY n, axis ORDER BY value) - 1 AS position FROM (
        SELECT DISTINCT CAST(substr(dataset_id, 4) AS INT) AS n, 'sentiment' AS axis, sentiment AS value
        FROM comments WHERE status = 'annotated'
        UNION SELECT DISTINCT CAST(substr(dataset_id, 4) AS INT), 'type', "type"
        FROM comments WHERE status = 'annotated') WHERE n % 2 = 0 AND n % 6 <> 0""",
    "defaults": """SELECT * FROM (VALUES ('sentiment', 'positive', 0), ('sentiment', 'negative', 1),
        ('sentiment', 'neutral', 2), ('sentiment', 'unannotated', 3), ('type', 'bangla', 0),
        ('type', 'english', 1), ('type', 'banglish', 2), ('type', 'unclassified', 3)) t(axis, value, position)""",
    "opts": """SELECT d.dataset_id, t.axis, t.value FROM ds d JOIN terms t ON t.taxonomy_id = d.taxonomy_id
        UNION SELECT d.dataset_id, x.axis, x.value FROM ds d CROSS JOIN defaults x
        WHERE x.value IN ('unannotated', 'unclassified')
           OR NOT EXISTS (SELECT 1 FROM terms t WHERE t.taxonomy_id = d.taxonomy_id)""",
    "users": """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name,
        lower(c_name || '@example.com') AS email,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'annotator' END AS role,
        c_acctbal > 0 AS is_active FROM customer""",
    "assets": """SELECT CAST(o_orderkey AS VARCHAR) AS asset_id, o_orderpriority AS dataset_id,
        CASE WHEN o_orderkey % 10 = 0 THEN 'video' ELSE 'image' END AS kind,
        CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'img_' || o_orderkey || '.png' END AS file_name,
        CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, 'c' || o_custkey AS checksum,
        CASE WHEN o_orderstatus <> 'P' THEN 320 + o_custkey % 1600 END AS width,
        CASE WHEN o_orderstatus <> 'P' THEN 240 + o_custkey % 900 END AS height,
        CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 5 AS VARCHAR) END AS assigned_to,
        o_orderdate AS created_at FROM orders""",
    "raw_boxes": """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CAST(floor(l_extendedprice * 100) AS BIGINT)) AS annotation_id,
        CAST(l_orderkey AS VARCHAR) AS asset_id,
        CASE WHEN l_tax = CAST(0.08 AS DOUBLE) THEN 'classification' ELSE 'bbox' END AS kind, l_returnflag AS label,
        l_discount * 12 - CAST(0.1 AS DOUBLE) AS x, l_tax * 5 AS y, l_quantity / 50 AS w, l_linenumber / 7 AS h,
        CASE WHEN l_orderkey % 10 = 0 THEN l_linenumber END AS frame_index,
        CASE WHEN l_orderkey % 10 = 0 THEN l_linenumber * 1000 END AS timestamp_ms,
        CAST(l_suppkey AS VARCHAR) AS created_by, l_shipdate AS created_at FROM lineitem""",
    "clamped": """SELECT *, least(greatest(x, 0.0), 1.0) AS l, least(greatest(y, 0.0), 1.0) AS t FROM raw_boxes""",
    "normal": """SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 'Box width and height must be greater than zero'
        WHEN least(w, 1 - l) <= 0 OR least(h, 1 - t) <= 0 THEN 'Box lies entirely outside the image' END AS reason,
        floor(l * 1e6 + 0.5) / 1e6 AS bx, floor(t * 1e6 + 0.5) / 1e6 AS bt,
        floor(least(w, 1 - l) * 1e6 + 0.5) / 1e6 AS bw, floor(least(h, 1 - t) * 1e6 + 0.5) / 1e6 AS bh
        FROM clamped""",
    "ann": """SELECT n.annotation_id, n.asset_id, a.dataset_id, n.kind, n.label,
        CASE WHEN n.kind = 'bbox' THEN bx END AS x, CASE WHEN n.kind = 'bbox' THEN bt END AS y,
        CASE WHEN n.kind = 'bbox' THEN bw END AS w, CASE WHEN n.kind = 'bbox' THEN bh END AS h,
        n.frame_index, n.timestamp_ms, n.created_by, n.created_at
        FROM normal n JOIN assets a ON a.asset_id = n.asset_id WHERE n.reason IS NULL""",
    "classes": """SELECT d.dataset_id, c.class_id, c.value FROM (SELECT DISTINCT dataset_id FROM assets) d
        CROSS JOIN (VALUES (0, 'R'), (1, 'A'), (2, 'Z')) c(class_id, value)
        WHERE d.dataset_id <> '4-NOT SPECIFIED'""",
    "counted": """SELECT a.*, b.boxes, b.total, b.first_frame FROM assets a JOIN (
        SELECT asset_id, count(*) AS total, count(*) FILTER (WHERE kind = 'bbox') AS boxes,
        arg_min(coalesce(frame_index, -1), (created_at, annotation_id)) FILTER (WHERE kind = 'bbox') AS first_frame
        FROM ann GROUP BY asset_id) b ON a.asset_id = b.asset_id""",
    "boxed": """SELECT b.*, a.kind AS asset_kind, a.file_name, a.width, a.height, a.created_at AS asset_at,
        c.class_id FROM ann b JOIN assets a ON a.asset_id = b.asset_id
        LEFT JOIN classes c ON c.dataset_id = b.dataset_id AND c.value = b.label WHERE b.kind = 'bbox'""",
    "pixels": """SELECT *, floor(x * width * 1e2 + 0.5) / 1e2 AS px, floor(y * height * 1e2 + 0.5) / 1e2 AS py,
        floor(w * width * 1e2 + 0.5) / 1e2 AS pw, floor(h * height * 1e2 + 0.5) / 1e2 AS ph
        FROM boxed WHERE class_id IS NOT NULL AND width > 0 AND height > 0""",
    "beats": """SELECT user_id, 'session-' || CAST(user_id AS BIGINT) % 3 AS session_key, ts, ms, day, event_id,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'active' WHEN event_type = 'view' THEN 'idle'
             ELSE 'away' END AS state, CASE WHEN event_type <> 'error' THEN event_type END AS action FROM ev""",
    "paired": """SELECT *, lag(ms) OVER w AS p_ms, lag(state) OVER w AS p_state FROM beats
        WINDOW w AS (PARTITION BY user_id, session_key ORDER BY ts, state)""",
    "credited": """SELECT *, CASE WHEN p_state = 'active' THEN least(ms - p_ms, 14400000) ELSE 0 END AS active_ms,
        CASE WHEN p_state = 'idle' THEN least(ms - p_ms, 14400000) ELSE 0 END AS idle_ms FROM paired""",
    "sess": """SELECT user_id, session_key, arg_max(state, (ts, state)) AS last_state, min(ms) AS started_ms,
        max(ms) AS last_ms, CAST(sum(active_ms) AS BIGINT) AS active_ms, CAST(sum(idle_ms) AS BIGINT) AS idle_ms,
        count(*) AS heartbeats, max(ms) FILTER (WHERE state = 'active') AS last_active_ms,
        arg_max(action, (ts, state)) FILTER (WHERE action IS NOT NULL) AS last_action
        FROM credited GROUP BY user_id, session_key""",
    "marked": """SELECT *, row_number() OVER (PARTITION BY file, sid, sid <> '' AND txt <> '' ORDER BY row_no) - 1 AS o
        FROM import_rows""",
}

DEPENDS = {
    "versions": ["ev"], "terms": ["comments"], "opts": ["ds", "terms", "defaults"], "clamped": ["raw_boxes"],
    "normal": ["clamped"], "ann": ["normal", "assets"], "classes": ["assets"], "counted": ["assets", "ann"],
    "boxed": ["ann", "assets", "classes"], "pixels": ["boxed"], "beats": ["ev"], "paired": ["beats"],
    "credited": ["paired"], "sess": ["credited"],
}


def with_tables(names: str, body: str, /, **extra: str) -> str:
    """``WITH`` the named tables (and what they need), then ``extra`` ones, then the query."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        for need in DEPENDS.get(name, []):
            add(need)
        done[name] = CTES[name]

    for name in names.split():
        if name != "marked":
            add(name)
    done.update(extra)
    if "marked" in names.split():
        tail = {k: done.pop(k) for k in list(extra) if k != "import_rows"}
        done["marked"] = CTES["marked"]
        done.update(tail)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in done.items()) + "\n" + body


def half_up(value: str, digits: int) -> str:
    return f"floor(CAST({value} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits}"


def percent(part: str, total: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 0 ELSE floor(CAST({part} AS DOUBLE) / {total} * 1e3 + 0.5) / 1e1 END"


def summary(source: str, keys: str) -> str:
    """Class-balance figures from a table of (keys, label, count)."""
    h = "sum(-p * log2(p))"
    most = "log2(CAST(count(*) AS DOUBLE))"
    return f"""SELECT {keys}, CAST(sum(count) AS BIGINT) AS total, count(*) AS classes, max(count) AS max, min(count) AS min,
        {half_up('max(count) / min(count)', 2)} AS imbalance_ratio, {half_up(h, 3)} AS entropy,
        CASE WHEN count(*) > 1 THEN {half_up(most, 3)} ELSE 0.0 END AS max_entropy,
        CASE WHEN count(*) > 1 THEN {half_up(f'{h} / {most}', 3)} ELSE 1.0 END AS balance_score,
        {half_up('1 - sum(p * p)', 3)} AS gini
        FROM (SELECT *, count / sum(count) OVER (PARTITION BY {keys}) AS p FROM {source} WHERE label IS NOT NULL) q
        GROUP BY {keys}"""


# The opening that decides a near copy in the reports.
NEAR_CHARS = 80
_FOLDED = "trim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
NEAR_TEXT = f"nullif({_FOLDED}, '')"
NEAR_KEY = (
    f"nullif(substr({_FOLDED}, 1, {NEAR_CHARS}), '')"
)


def bucket(length: str) -> str:
    bounds = [0, 20, 50, 100, 200, 500, 1000, 100000]
    cases = " ".join(
        f"WHEN {length} < {b} THEN '{a}–{b - 1}'" for a, b in zip(bounds, bounds[1:])
    )
    return f"CASE {cases} ELSE '100000+' END"


def plain(value: str, digits: int = 6) -> str:
    return f"regexp_replace(printf('%.{digits}f', {value}), '\\.?0+$', '')"


def guarded(value: str) -> str:
    raw = f"coalesce(CAST({value} AS VARCHAR), '')"
    text = f"CASE WHEN regexp_matches({raw}, '^[=+\\-@]') THEN chr(39) || {raw} ELSE {raw} END"
    return (
        f"(SELECT CASE WHEN contains(s, '\"') OR contains(s, ',') OR contains(s, chr(10)) OR contains(s, chr(13)) "
        f"THEN '\"' || replace(s, '\"', '\"\"') || '\"' ELSE s END FROM (SELECT {text} AS s))"
    )
