"""DuckDB SQL for every registered query whose result SQL can state.

The SQL is written independently of the operators: global windows, plain ranks and list
functions stand in for the distributed forms.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def ranked(key: str, seed: str = "42") -> str:
    return f"row_number() OVER (ORDER BY md5('{seed}:' || {key}::VARCHAR)) - 1"


def hash60(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


# Views

DIALOGUE_PAIRS = """dialogue_pairs AS (
  SELECT u.conv_id || ':' || u.turn AS row_key, u.text AS anchor, a.text AS positive, u.conv_id, u.turn
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

DOCUMENT_PAIRS = """document_pairs AS (
  SELECT doc_id AS row_key, split_part(text, '.', 1) AS anchor,
         coalesce(nullif(text[strpos(text || '.', '.') + 1:], ''), text) AS positive, lang
  FROM documents)"""


def triplets(source: str, out: str, neighbour: str) -> str:
    """Pairs with the positive of row y, the neighbour of row x, as negative, and their rank."""
    return f"""{out} AS (
  SELECT x.*, coalesce(y.positive, x.anchor) AS negative,
    {ranked('x.row_key')} AS idx, count(*) OVER () AS n
  FROM {source} x LEFT JOIN {source} y ON {neighbour})"""


DIALOGUES = DIALOGUE_PAIRS + ",\n" + triplets(
    "dialogue_pairs", "dialogues", "y.conv_id = x.conv_id + 1 AND y.turn = x.turn"
)
DOCS = DOCUMENT_PAIRS + ",\n" + triplets("document_pairs", "docs", "y.row_key = x.row_key + 1")

SUPERVISED = DIALOGUES + """,
supervised AS (
  SELECT row_key, anchor, positive, negative AS negative_1, anchor AS negative_2,
         positive AS negative_3, 'f' || (conv_id % 4) || '_supervised.csv' AS source_file
  FROM dialogues)"""

SOURCES = SUPERVISED + ",\n" + DOCS + """,
sources AS (
  SELECT 'c' || row_key AS row_key, anchor, positive, negative_1 AS negative, source_file,
         'supervised' AS source_kind FROM supervised
  UNION ALL
  SELECT 'd' || row_key, anchor, positive, negative, 'detailed_top20.csv', 'detailed' FROM docs)"""


def split_label(idx: str, n: str) -> str:
    held = f"ceil({n} * 0.2::DOUBLE)"
    return (
        f"CASE WHEN {idx} < {n} - {held} THEN 'train' "
        f"WHEN {idx} < {n} - ceil({held} * 0.5::DOUBLE) THEN 'val' ELSE 'test' END"
    )


VERSIONS = SOURCES + f""",
supervised_ranked AS (
  SELECT *, {ranked('row_key')} AS i, count(*) OVER () AS total
  FROM sources WHERE source_kind = 'supervised'),
supervised_split AS (
  SELECT row_key, anchor, positive, negative, source_file, source_kind,
         {split_label('i', 'total')} AS split FROM supervised_ranked),
versions AS (
  SELECT *, 'supervised_only' AS data_version FROM supervised_split
  UNION ALL
  SELECT *, 'supervised_with_detailed' FROM supervised_split
  UNION ALL
  SELECT row_key, anchor, positive, negative, source_file, source_kind, 'train',
         'supervised_with_detailed' FROM sources WHERE source_kind = 'detailed')"""

VECTORS = f"""base_vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
vectors AS (
  SELECT x.vec_id AS row_key, x.v AS anchor, coalesce(y.v, x.v) AS positive,
    coalesce(z.v, x.v) AS negative, {ranked('x.vec_id')} AS idx, count(*) OVER () AS n
  FROM base_vectors x LEFT JOIN base_vectors y ON y.vec_id = x.vec_id + 1
  LEFT JOIN base_vectors z ON z.vec_id = x.vec_id + 2)"""


def cosine(a: str, b: str) -> str:
    return (
        f"(list_dot_product({a}, {b}) / "
        f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"
    )


def draws(table: str, m: int, out: str = "drawn") -> str:
    """m other rows per row of a table with idx and n."""
    start = hash60("'42:negatives:' || row_key::VARCHAR")
    return f"""{out}_targets AS (
  SELECT row_key, anchor AS own_anchor, j AS draw,
         (idx + 1 + ({start} + j) % (n - 1)) % n AS target
  FROM {table}, range({m}) t(j) WHERE j < n - 1),
{out} AS (
  SELECT t.row_key, t.draw::INTEGER AS draw, o.row_key AS neg_key, o.positive AS neg_positive,
         o.negative AS neg_negative, t.own_anchor, o.anchor AS neg_anchor
  FROM {out}_targets t JOIN {table}_by_idx o ON o.idx = t.target)"""


def by_idx(table: str) -> str:
    """Rows of a triplet table by their own seeded rank (the rank of its full key set)."""
    return f"{table}_by_idx AS (SELECT * FROM {table})"


def basic_lists(table: str, m: int, out: str = "slots") -> str:
    """(row_key, slot, passage, origin): own passages and those of m drawn rows."""
    own = f"""SELECT row_key, 0 AS slot, positive AS passage, 'positive' AS origin FROM {table}
  UNION ALL SELECT row_key, 1, negative, 'negative' FROM {table}"""
    if m == 0:
        return f"{out} AS ({own})"
    return f"""{by_idx(table)},
{draws(table, m)},
{out} AS ({own}
  UNION ALL SELECT row_key, 2 + 2 * draw, neg_positive, 'drawn' FROM drawn
  UNION ALL SELECT row_key, 3 + 2 * draw, neg_negative, 'drawn' FROM drawn)"""


KEYED_DOCS = DOCS + """,
keyed AS (SELECT row_key, anchor, md5(positive) AS positive, md5(negative) AS negative, idx, n
  FROM docs)"""


def pool(table: str) -> str:
    return f"""pool_passages AS (
  SELECT DISTINCT passage FROM (SELECT positive AS passage FROM {table}
    UNION ALL SELECT negative FROM {table}) WHERE passage IS NOT NULL),
pool AS (SELECT passage, {ranked('passage')} AS pid, count(*) OVER () AS p FROM pool_passages)"""


def filled(slots: str, k: int, out: str = "filled", barred: str = "SELECT NULL AS row_key, NULL AS passage") -> str:
    """Short lists get allowed pool passages they lack, in a circle from a hashed rank among
    the allowed ones, if there are enough; `barred` has (row_key, passage)."""
    start = hash60("'42:fill:' || row_key::VARCHAR")
    return f"""sizes AS (SELECT row_key, count(*) AS len FROM {slots} GROUP BY row_key),
fill_barred AS ({barred}),
fill_allowed AS (
  SELECT s.row_key, s.len, pool.passage, count(*) OVER of_list AS n,
         row_number() OVER (PARTITION BY s.row_key ORDER BY pid) - 1 AS rank
  FROM sizes s JOIN pool ON s.len < {k}
    AND NOT EXISTS (SELECT 1 FROM fill_barred b WHERE b.row_key = s.row_key AND b.passage = pool.passage)
  WINDOW of_list AS (PARTITION BY s.row_key)),
fill_unused AS (
  SELECT row_key, len, passage, row_number() OVER (PARTITION BY row_key ORDER BY (rank - {start} % n + n) % n) AS r,
         count(*) OVER (PARTITION BY row_key) AS found
  FROM fill_allowed f
  WHERE NOT EXISTS (SELECT 1 FROM {slots} o WHERE o.row_key = f.row_key AND o.passage = f.passage)),
{out} AS (
  SELECT row_key, slot, passage, origin FROM {slots}
  UNION ALL
  SELECT row_key, len + r - 1, passage, 'pool' FROM fill_unused
  WHERE found >= {k} - len AND r <= {k} - len)"""


def repeated(slots: str, k: int, out: str = "repeated") -> str:
    return f"""lens AS (SELECT row_key, count(*) AS len FROM {slots} GROUP BY row_key),
{out} AS (
  SELECT l.row_key, s.slot, o.passage,
         CASE WHEN s.slot < l.len THEN o.origin ELSE 'repeat' END AS origin
  FROM lens l, range({k}) s(slot) JOIN {slots} o
    ON o.row_key = l.row_key AND o.slot = s.slot % l.len)"""


VECTOR_LISTS = VECTORS + ",\n" + basic_lists("vectors", 3) + f""",
vector_batches AS (SELECT vec_id AS qid, ({ranked('vec_id', '42/0')}) // 16 AS batch_id FROM embeddings),
score_lists AS (
  SELECT b.batch_id, s.row_key AS qid, s.slot,
    1 / (1 + exp(-4::DOUBLE * {cosine('v.anchor', 's.passage')})) AS teacher,
    ({cosine('v.anchor', 's.passage')} + 1) / 2 AS student
  FROM slots s JOIN vectors v ON v.row_key = s.row_key JOIN vector_batches b ON b.qid = s.row_key
  WHERE s.slot < 8)"""

SHARES = """exps AS (
  SELECT *, exp(teacher / 0.2::DOUBLE - max(teacher / 0.2::DOUBLE) OVER w) AS et,
            exp(student / 0.2::DOUBLE - max(student / 0.2::DOUBLE) OVER w) AS es
  FROM score_lists WINDOW w AS (PARTITION BY batch_id, qid)),
shares AS (
  SELECT batch_id, qid, slot, teacher, student, et / sum(et) OVER w AS p, es / sum(es) OVER w AS q
  FROM exps WINDOW w AS (PARTITION BY batch_id, qid))"""
VECTOR_SHARES = VECTOR_LISTS + ",\n" + SHARES

QUERY_LOSSES = SHARES + """,
per_query AS (
  SELECT batch_id, qid, sum(p * (ln(p + 1e-12::DOUBLE) - ln(q + 1e-12::DOUBLE))) AS kl,
    avg(student) FILTER (teacher > 0.5) AS pos_mean,
    avg(student) FILTER (teacher <= 0.5) AS neg_mean,
    sum(student) FILTER (teacher <= 0.5) AS neg_sum,
    count(*) FILTER (teacher <= 0.5) AS neg_count
  FROM shares GROUP BY batch_id, qid)"""

BATCH_LOSSES = QUERY_LOSSES + """,
per_batch AS (
  SELECT batch_id, avg(kl) AS kl,
    coalesce(avg(greatest(0.7::DOUBLE - (pos_mean - neg_mean), 0))
      FILTER (pos_mean IS NOT NULL AND neg_mean IS NOT NULL), 0) AS margin_loss,
    CASE WHEN sum(neg_count) > 0 THEN
      greatest(sum(neg_sum) / sum(neg_count) - 0.15::DOUBLE, 0)
      + 0.5::DOUBLE * avg(greatest(neg_mean - 0.15::DOUBLE, 0)) FILTER (neg_mean IS NOT NULL)
    ELSE 0 END AS penalty
  FROM per_query GROUP BY batch_id)"""


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[ \\n\\t\\r]+'), lambda t: t <> '')"


def encoded(name: str, rows: str) -> str:
    """(row_key, lane, value): unit hashed token counts of (row_key, text) rows."""
    return f"""{name}_tokens AS (
  SELECT row_key, unnest({tokens('lower(text)')}) AS t FROM ({rows})),
{name}_lanes AS (SELECT row_key, {hash60('t')} % 128 AS h FROM {name}_tokens),
{name}_counts AS (
  SELECT row_key, h % 64 AS lane, sum(CASE WHEN h < 64 THEN 1 ELSE -1 END)::DOUBLE AS c
  FROM {name}_lanes GROUP BY 1, 2),
{name} AS (
  SELECT row_key, lane, c / sqrt(sum(c * c) OVER (PARTITION BY row_key)) AS value
  FROM {name}_counts WHERE c <> 0)"""


TEXT_SCORES = (
    DOCS + ",\n"
    + encoded("ea", "SELECT row_key, 'query: (ko) ' || anchor AS text FROM docs") + ",\n"
    + encoded("ep", "SELECT row_key, 'passage: (ko) ' || positive AS text FROM docs") + ",\n"
    + encoded("en", "SELECT row_key, 'passage: (ko) ' || negative AS text FROM docs") + """,
cos_p AS (SELECT a.row_key, sum(a.value * p.value) AS c FROM ea a JOIN ep p
  ON p.row_key = a.row_key AND p.lane = a.lane GROUP BY 1),
cos_n AS (SELECT a.row_key, sum(a.value * p.value) AS c FROM ea a JOIN en p
  ON p.row_key = a.row_key AND p.lane = a.lane GROUP BY 1),
scores AS (
  SELECT *, pos_score - neg_score AS margin FROM (
    SELECT *, (pos_raw + 1) / 2 AS pos_score, (neg_raw + 1) / 2 AS neg_score FROM (
      SELECT d.row_key, coalesce(p.c, 0) AS pos_raw, coalesce(n.c, 0) AS neg_raw
      FROM docs d LEFT JOIN cos_p p ON p.row_key = d.row_key
      LEFT JOIN cos_n n ON n.row_key = d.row_key)))"""
)

VECTOR_SCORES = VECTORS + f""",
scores AS (
  SELECT *, pos_score - neg_score AS margin FROM (
    SELECT *, (pos_raw + 1) / 2 AS pos_score, (neg_raw + 1) / 2 AS neg_score FROM (
      SELECT row_key, {cosine('anchor', 'positive')} AS pos_raw,
             {cosine('anchor', 'negative')} AS neg_raw FROM vectors)))"""

SCORE_COLUMNS = ", ".join(
    f"round({c}, 8) AS {c}" for c in ("pos_raw", "neg_raw", "pos_score", "neg_score", "margin")
)

REPORT = """report AS (
  SELECT avg(pos_score) AS pos_cosine_similarity_mean,
    stddev_pop(pos_score) AS pos_cosine_similarity_std,
    avg(neg_score) AS neg_cosine_similarity_mean,
    stddev_pop(neg_score) AS neg_cosine_similarity_std,
    avg(margin) AS margin_mean, stddev_pop(margin) AS margin_std,
    var_pop(pos_score) AS pos_uniformity, var_pop(neg_score) AS neg_uniformity,
    (SELECT var_pop(s) FROM (SELECT pos_score AS s FROM scores
      UNION ALL SELECT neg_score FROM scores)) AS overall_uniformity,
    count(*) AS total_samples FROM scores)"""

REPORT_COLUMNS = ", ".join(
    f"round({c}, 6) AS {c}"
    for c in (
        "pos_cosine_similarity_mean", "pos_cosine_similarity_std", "neg_cosine_similarity_mean",
        "neg_cosine_similarity_std", "margin_mean", "margin_std", "pos_uniformity",
        "neg_uniformity", "overall_uniformity",
    )
) + ", total_samples"

FEATURES = """{name}_sets AS (
  SELECT *, list_distinct({a}) AS ta, list_distinct({b}) AS tb FROM ({rows})),
{name}_sizes AS (
  SELECT *, len(list_intersect(ta, tb))::DOUBLE AS shared, len(ta)::DOUBLE AS na,
         len(tb)::DOUBLE AS nb FROM {name}_sets),
{name} AS (
  SELECT *, 4.0::DOUBLE * jaccard + 6.0::DOUBLE * coverage + 0.5::DOUBLE * length_ratio
    - 2.0::DOUBLE AS logit
  FROM (SELECT *,
    CASE WHEN na + nb - shared > 0 THEN shared / (na + nb - shared) ELSE 0 END AS jaccard,
    CASE WHEN na > 0 THEN shared / na ELSE 0 END AS coverage,
    CASE WHEN greatest(na, nb) > 0 THEN least(na, nb) / greatest(na, nb) ELSE 0 END AS length_ratio
    FROM {name}_sizes))"""


def features(name: str, rows: str) -> str:
    return FEATURES.format(
        name=name, rows=rows, a=tokens("lower(query)"), b=tokens("lower(passage)")
    )


LABELLED = """labelled AS (
  SELECT row_key, 0 AS side, 'query: (ko) ' || anchor AS query_text,
         'passage: (ko) ' || positive AS passage_text, 1.0::DOUBLE AS label FROM {t}
  UNION ALL
  SELECT row_key, 1, 'query: (ko) ' || anchor, 'passage: (ko) ' || negative, 0.0::DOUBLE FROM {t})"""

LOG = """log_raw AS (
  SELECT 'run-' || (user_id // 10) AS run_id, ((day(ts) - 1) // 15)::INTEGER AS attempt,
    event_id, ts,
    CASE event_type
      WHEN 'view' THEN 'Training: ' || (floor(value)::BIGINT % 101) || '%'
      WHEN 'click' THEN '[Train] Loss: ' || value
      WHEN 'signup' THEN '[Epoch ' || (((day(ts) - 1) % 15) // 5 + 1) || '/3]'
      WHEN 'purchase' THEN CASE WHEN event_id % 50 = 0 THEN '학습 완료!' ELSE 'batch done' END
      ELSE CASE WHEN value > 250 THEN CASE event_id % 4
          WHEN 0 THEN 'RuntimeError: CUDA out of memory'
          WHEN 1 THEN 'cuda driver error: 3'
          WHEN 2 THEN 'ModuleNotFoundError: No module named x'
          ELSE 'ValueError exception raised' END
        ELSE 'retry scheduled' END
    END AS line
  FROM events),
log AS (
  SELECT run_id, attempt, ts, line,
    row_number() OVER (PARTITION BY run_id, attempt ORDER BY ts, event_id) - 1 AS line_no
  FROM log_raw)"""


def holds(column: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in patterns) + ")"


FLAGS = f"""flags AS (
  SELECT *,
    {holds('lower(line)', '모델 저장 완료', '학습 완료', 'training completed',
           '모델이 저장되었습니다', 'saved model')} AS is_complete,
    {holds('lower(line)', 'out of memory', 'cuda out of memory', 'nvml',
           'runtimeerror: nvml_success')} AS is_gpu_memory,
    {holds('lower(line)', 'cuda runtime error', 'cuda driver error',
           'cuda initialization error', 'cuda error')} AS is_cuda,
    {holds('lower(line)', 'import error', 'modulenotfounderror')} AS is_import,
    {holds('lower(line)', 'error', 'exception', 'traceback')} AS is_general,
    {holds('lower(line)', 'error', 'exception')} AS is_message
  FROM log)"""

REFERENCE_FLAGS = f"""flags AS (
  SELECT *,
    {holds('lower(line)', '모델 저장 완료', '학습 완료', 'training completed',
           '모델이 저장되었습니다', 'saved model', 'epoch 3/3',
           '100%|██████████|')} AS is_complete,
    {holds('lower(line)', '100%', '완료', 'complete')} AS is_complete_tail,
    {holds('line', 'out of memory', 'cuda out of memory', 'nvml',
           'runtimeerror: nvml_success', 'cuda error')} AS is_gpu_memory,
    {holds('line', 'cuda runtime error', 'cuda driver error',
           'cuda initialization error')} AS is_cuda,
    ({holds('lower(line)', 'import error')} OR {holds('line', 'moduleNotFoundError')}) AS is_import,
    {holds('lower(line)', 'error', 'exception', 'traceback')} AS is_general,
    {holds('lower(line)', 'error', 'exception')} AS is_message
  FROM log)"""


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def status(group: str, source: str, complete_tail: bool = False) -> str:
    """Status per group from lines that know how far `back` they are."""
    also = " OR bool_or(is_complete_tail AND back <= 10)" if complete_tail else ""
    return f"""judged AS (
  SELECT {group}, max(line_no) AS last_line, max(ts) AS last_ts,
    bool_or(is_complete AND back <= 100){also} AS is_complete,
    CASE WHEN bool_or(is_gpu_memory AND back <= 200) THEN 'gpu_memory'
         WHEN bool_or(is_cuda AND back <= 200) THEN 'cuda'
         WHEN bool_or(is_import AND back <= 200) THEN 'import'
         WHEN bool_or(is_general AND back <= 200) AND bool_or(is_message AND back <= 50)
           THEN 'general' END AS error_type,
    arg_max(trim(line, {BLANKS})[1:100], line_no) FILTER (is_message AND back <= 50) AS message_text,
    arg_max(trim(line, {BLANKS}), line_no) AS last_text
  FROM {source} GROUP BY {group}),
statuses AS (
  SELECT *, CASE WHEN is_complete THEN 'complete' WHEN error_type IS NOT NULL THEN 'error'
                 ELSE 'running' END AS status,
    CASE error_type WHEN 'gpu_memory' THEN 'GPU 메모리 부족 에러 감지'
      WHEN 'cuda' THEN 'CUDA 에러 감지' WHEN 'import' THEN 'Import 에러 감지'
      WHEN 'general' THEN '에러 감지: ' || message_text END AS error_message,
    CASE WHEN contains(last_text, 'Training:') THEN right(last_text, 80) END AS progress
  FROM judged)"""


BACK = """backwards AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, attempt ORDER BY line_no DESC) AS back
  FROM flags)"""

FINAL = with_(LOG, FLAGS, BACK, status("run_id, attempt", "backwards"))
FINAL_REFERENCE = with_(
    LOG, REFERENCE_FLAGS, BACK, status("run_id, attempt", "backwards", complete_tail=True)
)

POLLS = (
    LOG + ",\n" + FLAGS + """,
polled AS (SELECT *, floor(epoch(ts) / 21600)::BIGINT AS own_poll FROM flags),
poll_ends AS (
  SELECT run_id, attempt, own_poll AS poll, max(line_no) AS end_line
  FROM polled GROUP BY 1, 2, 3),
as_of AS (
  SELECT e.poll, p.*, e.end_line - p.line_no + 1 AS back
  FROM poll_ends e JOIN polled p ON p.run_id = e.run_id AND p.attempt = e.attempt
    AND p.line_no <= e.end_line),
""" + status("run_id, attempt, poll", "as_of") + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, attempt ORDER BY poll) AS position,
    sum(CASE WHEN status <> 'error' THEN 1 ELSE 0 END)
      OVER (PARTITION BY run_id, attempt ORDER BY poll) AS island
  FROM statuses),
streaks AS (
  SELECT *, (CASE WHEN status = 'error' THEN
      sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END)
        OVER (PARTITION BY run_id, attempt, island ORDER BY poll) ELSE 0 END)::INTEGER AS streak
  FROM numbered),
stops AS (
  SELECT run_id, attempt, min(poll) AS stop FROM streaks
  WHERE status = 'complete' OR streak >= 3 GROUP BY 1, 2),
monitored AS (
  SELECT s.run_id, s.attempt, s.poll, s.last_line,
    strftime(s.last_ts, '%Y-%m-%d %H:%M:%S') AS seen_at,
    floor(epoch(s.last_ts))::BIGINT AS seen_epoch, s.status, s.error_type, s.error_message,
    s.progress, s.streak,
    CASE WHEN s.status = 'complete' THEN 'evaluate'
         WHEN s.status = 'error' AND s.streak >= 3 THEN 'halt'
         WHEN s.status = 'error' THEN 'recover' ELSE 'none' END AS action
  FROM streaks s LEFT JOIN stops t ON t.run_id = s.run_id AND t.attempt = s.attempt
  WHERE t.stop IS NULL OR s.poll <= t.stop)"""
)

BATCHES = """batches AS (
  SELECT (user_id // 10)::VARCHAR AS run_id,
    CASE WHEN event_type IN ('view', 'signup') THEN 'val' ELSE 'train' END AS phase,
    day(ts)::BIGINT AS epoch, event_id AS batch_id,
    CASE WHEN event_type <> 'error' THEN ln(1 + value) END AS loss,
    CASE WHEN event_type = 'error' THEN 'skipped' ELSE 'ok' END AS status FROM events)"""

EPOCHS = BATCHES + """,
epochs AS (
  SELECT run_id, epoch,
    avg(loss) FILTER (phase = 'train' AND status = 'ok') AS train_loss,
    round(avg(loss) FILTER (phase = 'val'), 4) AS val_loss
  FROM batches GROUP BY run_id, epoch)"""


# Queries

MD5_TRIPLET = "md5(anchor) AS anchor, md5(positive) AS positive, md5(negative) AS negative"

ORACLES["scan_supervised"] = with_(SUPERVISED) + """
SELECT anchor, positive, source_file,
  CASE WHEN source_file = 'f3_supervised.csv' THEN NULL ELSE negative_1 END AS negative_1
FROM supervised"""
ORACLES["scan_detailed"] = with_(DOCS) + """
SELECT anchor, positive AS original_positive, negative AS best_other_positive,
  'detailed_top20.csv' AS source_file FROM docs"""
ORACLES["prepare_versions"] = with_(SUPERVISED, DOCS) + f"""
, kept AS (SELECT count(*) AS n FROM supervised WHERE source_file <> 'f3_supervised.csv'),
parts AS (SELECT {split_label('i', 'n')} AS split FROM kept, range((SELECT n FROM kept)) t(i)),
sizes AS (SELECT split, count(*) AS c FROM parts GROUP BY split),
added AS (SELECT count(*) AS d FROM docs)
SELECT 'supervised_only' AS data_version, split, c AS n_rows, c AS n_supervised,
  0::BIGINT AS n_detailed FROM sizes
UNION ALL
SELECT 'supervised_with_detailed', split, c + CASE WHEN split = 'train' THEN d ELSE 0 END, c,
  CASE WHEN split = 'train' THEN d ELSE 0 END FROM sizes, added"""
ORACLES["read_triplets"] = with_(DOCUMENT_PAIRS) + """,
raw AS (SELECT anchor, positive, lang AS negative FROM document_pairs),
counted AS (SELECT *, row_number() OVER (PARTITION BY anchor, positive, negative) AS occurrence
  FROM raw),
keyed AS (SELECT *, md5(anchor || chr(1) || negative || chr(1) || positive || chr(1)
  || occurrence) AS row_key FROM counted)
SELECT row_key, md5(anchor) AS anchor, md5(positive) AS positive, negative FROM keyed"""
ORACLES["write_splits"] = with_(VERSIONS) + """
SELECT data_version, split, row_key, source_kind, md5(positive) AS positive,
  md5(negative) AS negative FROM versions"""
ORACLES["scan_version_split"] = with_(VERSIONS) + """
SELECT row_key, source_kind, md5(anchor) AS anchor FROM versions
WHERE data_version = 'supervised_with_detailed' AND split = 'train'"""
ORACLES["write_csv_splits"] = with_(VERSIONS) + f"""
SELECT {MD5_TRIPLET} FROM versions
WHERE data_version = 'supervised_with_detailed' AND split = 'train'"""
ORACLES["write_report"] = with_(VECTOR_SCORES, REPORT) + f"SELECT {REPORT_COLUMNS} FROM report"
ORACLES["log_stream"] = with_(LOG) + "SELECT run_id, attempt, line_no, line FROM log"

ORACLES["project_supervised"] = with_(SUPERVISED) + """
SELECT anchor, positive, negative_1 AS negative, source_file, 'supervised' AS source_kind
FROM supervised"""
ORACLES["project_detailed"] = with_(DOCS) + f"""
SELECT {MD5_TRIPLET}, 'detailed' AS source_kind FROM docs"""
ORACLES["union_sources"] = with_(SOURCES) + f"""
SELECT {MD5_TRIPLET}, source_file, source_kind FROM sources"""
ORACLES["source_report"] = with_(SOURCES) + """
SELECT source_kind, source_file AS file_name, count(*) AS n_rows FROM sources GROUP BY 1, 2"""
ORACLES["split_report"] = with_(VERSIONS) + """
SELECT data_version, split, count(*) AS n_rows,
  count(*) FILTER (source_kind = 'supervised') AS n_supervised,
  count(*) FILTER (source_kind = 'detailed') AS n_detailed FROM versions GROUP BY 1, 2"""
ORACLES["format_pairs"] = with_(DIALOGUES) + """
SELECT row_key, 'query: (ko) ' || anchor AS query_text,
  'passage: (ko) ' || positive AS positive_text, 'passage: (ko) ' || negative AS negative_text
FROM dialogues"""
ORACLES["format_pairs_by_language"] = with_(DOCUMENT_PAIRS) + """
SELECT row_key, 'query: (' || lang || ') ' || anchor AS query_text,
  md5('passage: (' || lang || ') ' || positive) AS positive_text FROM document_pairs"""
ORACLES["label_pairs"] = with_(DOCS, LABELLED.format(t="docs")) + """
SELECT row_key, side, query_text, md5(passage_text) AS passage_text, label FROM labelled"""
ORACLES["pair_text"] = with_(DIALOGUES, LABELLED.format(t="dialogues")) + """
SELECT row_key, side, query_text || ' [SEP] ' || passage_text AS pair_text FROM labelled"""
ORACLES["null_policy"] = """
SELECT d.doc_id AS row_key, d.lang AS anchor, d.source AS positive,
  coalesce(l.quality::VARCHAR, 'nan') AS negative
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
ORACLES["null_drop"] = """
SELECT d.doc_id AS row_key, d.lang AS anchor, d.source AS positive,
  l.quality::VARCHAR AS negative FROM documents d JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality IS NOT NULL AND d.lang IS NOT NULL AND d.source IS NOT NULL"""
ORACLES["null_report"] = """
SELECT count(l.quality) AS kept, count(*) - count(l.quality) AS dropped
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
ORACLES["clip_tokens"] = f"""
SELECT doc_id, md5(array_to_string(words[1:256], ' ')) AS clipped, len(words) AS n_tokens,
  len(words) > 256 AS was_clipped
FROM (SELECT doc_id, {tokens('text')} AS words FROM documents)"""

ORACLES["dense_index"] = f"""
SELECT doc_id, lang, {ranked('doc_id')} AS idx, count(*) OVER () AS n_rows FROM documents"""
ORACLES["sample_n"] = """
SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id) LIMIT 300"""
ORACLES["split_exact"] = f"""
SELECT doc_id, lang, {split_label('i', 'n')} AS split
FROM (SELECT *, {ranked('doc_id')} AS i, count(*) OVER () AS n FROM documents)"""


ORACLES["split_exact_grouped"] = with_(DOCUMENT_PAIRS) + f"""
, anchors AS (SELECT anchor, {ranked('anchor')} AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT anchor FROM document_pairs))
SELECT p.row_key, {split_label('a.i', 'a.n')} AS split
FROM document_pairs p JOIN anchors a ON a.anchor = p.anchor"""


def hash_split(key: str) -> str:
    unit = f"{hash60(key)} / 1152921504606846976.0::DOUBLE"
    return (
        f"CASE WHEN {unit} < 0.8::DOUBLE THEN 'train' WHEN {unit} < 0.9::DOUBLE THEN 'val' "
        "ELSE 'test' END"
    )


ORACLES["split_hash"] = f"""
SELECT doc_id, lang, {hash_split("'42:' || doc_id")} AS split FROM documents"""
ORACLES["split_hash_grouped"] = with_(DOCUMENT_PAIRS) + f"""
SELECT row_key, {hash_split("'42:' || anchor")} AS split FROM document_pairs"""
ORACLES["dataset_versions"] = with_(VERSIONS) + """
SELECT row_key, source_kind, split, data_version FROM versions"""
ORACLES["assign_batches"] = f"""
SELECT doc_id, lang, i // 16 AS batch_id, (i % 16)::INTEGER AS batch_row
FROM (SELECT *, {ranked('doc_id', '42/1')} AS i FROM documents)"""

ORACLES["random_negatives"] = with_(DOCS, by_idx("docs"), draws("docs", 7)) + """
SELECT row_key, draw, neg_key, md5(neg_positive) AS neg_positive,
  md5(neg_negative) AS neg_negative FROM drawn"""
ORACLES["random_negatives_other_anchor"] = with_(DOCS, by_idx("docs"), draws("docs", 7)) + """
SELECT row_key, draw, neg_key FROM drawn WHERE own_anchor <> neg_anchor"""
ORACLES["passage_pool"] = with_(DOCS, pool("docs")) + """
SELECT pid, md5(passage) AS passage FROM pool"""
ORACLES["fill_candidates"] = with_(
    KEYED_DOCS, basic_lists("keyed", 0), pool("keyed"), filled("slots", 6)
) + "SELECT row_key, slot::INTEGER AS slot, passage, origin FROM filled"
ORACLES["repeat_candidates"] = with_(
    KEYED_DOCS, basic_lists("keyed", 0), repeated("slots", 7)
) + "SELECT row_key, slot::INTEGER AS slot, passage, origin FROM repeated"
ORACLES["candidate_lists"] = with_(
    KEYED_DOCS, basic_lists("keyed", 6), pool("keyed"), filled("slots", 15), repeated("filled", 15)
) + "SELECT row_key, slot::INTEGER AS slot, passage, origin FROM repeated"
ORACLES["candidate_lists_other_anchor"] = with_(
    KEYED_DOCS, by_idx("keyed"), draws("keyed", 6),
    """others AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY draw) - 1 AS place
  FROM drawn WHERE own_anchor IS DISTINCT FROM neg_anchor),
slots AS (SELECT row_key, 0 AS slot, positive AS passage, 'positive' AS origin FROM keyed
  UNION ALL SELECT row_key, 1, negative, 'negative' FROM keyed
  UNION ALL SELECT row_key, 2 + 2 * place, neg_positive, 'drawn' FROM others
  UNION ALL SELECT row_key, 3 + 2 * place, neg_negative, 'drawn' FROM others)""",
    pool("keyed"),
    filled("slots", 15, barred="""SELECT DISTINCT q.row_key, o.positive AS passage FROM keyed q JOIN keyed o
  ON o.anchor IS NOT DISTINCT FROM q.anchor"""),
    repeated("filled", 15),
) + "SELECT row_key, slot::INTEGER AS slot, passage, origin FROM repeated"
ORACLES["candidate_stats"] = with_(KEYED_DOCS, basic_lists("keyed", 3)) + """
SELECT count(*) AS n_queries, round(avg(c), 6) AS mean_candidates,
  (SELECT count(DISTINCT passage) FROM slots) AS n_passages
FROM (SELECT row_key, count(*) AS c FROM slots GROUP BY row_key)"""

# every query against every vector
ORACLES["mined_negatives"] = with_(VECTORS) + f"""
, passages AS (SELECT positive, min(row_key) AS neg_key FROM vectors GROUP BY positive),
scored AS (SELECT v.row_key, p.neg_key, {cosine('v.anchor', 'p.positive')} AS score
  FROM vectors v JOIN passages p ON NOT EXISTS (
    SELECT 1 FROM vectors o WHERE o.anchor = v.anchor AND o.positive = p.positive)),
placed AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY score DESC, neg_key) AS rank FROM scored)
SELECT row_key, rank::INTEGER AS rank, neg_key, round(score, 6) AS score FROM placed WHERE rank <= 4"""
ORACLES["retrieve_passages"] = f"""
WITH scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, {cosine('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM placed WHERE rank <= 10"""
ORACLES["top_labelled_vectors"] = """
SELECT label, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM (
  SELECT label, vec_id, embedding[1]::DOUBLE AS score,
    row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings)
WHERE rank <= 3"""

# estimates have no SQL twin: their stated errors hold
ORACLES["merged_sketches"] = """
SELECT lang, count(*) AS n, TRUE AS distinct_holds, TRUE AS median_holds FROM documents GROUP BY lang"""

ORACLES["encode_hashed"] = with_(
    encoded("e", "SELECT doc_id AS row_key, text FROM documents")
) + "SELECT row_key AS doc_id, lane::INTEGER AS lane, round(value, 6) AS value FROM e"
ORACLES["pair_cosine"] = with_(VECTORS) + f"""
SELECT row_key, round({cosine('anchor', 'positive')}, 6) AS cos_raw,
  round(({cosine('anchor', 'positive')} + 1) / 2, 6) AS score FROM vectors"""
ORACLES["pair_cosine_relu"] = with_(VECTORS) + f"""
SELECT row_key, round({cosine('anchor', 'negative')}, 6) AS cos_raw,
  round(greatest({cosine('anchor', 'negative')}, 0), 6) AS score FROM vectors"""
ORACLES["triplet_scores"] = with_(TEXT_SCORES) + f"SELECT row_key, {SCORE_COLUMNS} FROM scores"
ORACLES["vector_triplet_scores"] = (
    with_(VECTOR_SCORES) + f"SELECT row_key, {SCORE_COLUMNS} FROM scores"
)
ORACLES["attach_vectors"] = f"""
SELECT a.vec_id AS row_key, a.vec_id AS query_id, b.vec_id AS passage_id,
  round(({cosine('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} + 1) / 2, 6) AS student
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id % 7"""
ORACLES["list_scores"] = with_(VECTOR_LISTS) + """
SELECT qid, slot::INTEGER AS slot, round(student, 6) AS student FROM score_lists"""

DIALOGUE_LISTS = DIALOGUES + ",\n" + basic_lists("dialogues", 3) + """,
candidates AS (SELECT s.row_key, s.slot, d.anchor AS query, s.passage FROM slots s
  JOIN dialogues d ON d.row_key = s.row_key WHERE s.slot < 8)"""
ORACLES["teacher_scores"] = with_(
    DIALOGUE_LISTS, features("scored", "SELECT * FROM candidates")
) + """
SELECT row_key, slot::INTEGER AS slot, round(jaccard, 6) AS jaccard, round(coverage, 6) AS coverage,
  round(length_ratio, 6) AS length_ratio, round(logit, 6) AS logit,
  round(1 / (1 + exp(-logit)), 6) AS teacher FROM scored"""
ORACLES["teacher_scores_with"] = with_(DIALOGUE_LISTS) + """
SELECT row_key, slot::INTEGER AS slot,
  round(length(query)::DOUBLE / (length(query) + length(passage)), 6) AS teacher FROM candidates"""

ORACLES["listwise_softmax"] = with_(VECTOR_SHARES) + """
SELECT batch_id, qid, slot::INTEGER AS slot, round(p, 6) AS p, round(q, 6) AS q FROM shares"""
ORACLES["query_losses"] = with_(VECTOR_LISTS, QUERY_LOSSES) + """
SELECT batch_id, qid, round(kl, 6) AS kl, round(pos_mean, 6) AS pos_mean,
  round(neg_mean, 6) AS neg_mean, round(neg_sum, 6) AS neg_sum, neg_count FROM per_query"""
for _name, _column in (("kl", "kl"), ("margin", "margin_loss"), ("penalty", "penalty")):
    ORACLES[f"loss_{_name}"] = (
        with_(VECTOR_LISTS, BATCH_LOSSES) + f"SELECT batch_id, round({_column}, 6) AS {_column} FROM per_batch"
    )
TOTALS = """
SELECT batch_id, round(kl, 6) AS kl, round(margin_loss, 6) AS margin_loss,
  round(penalty, 6) AS penalty,
  round(kl + 0.3::DOUBLE * margin_loss + 0.4::DOUBLE * penalty, 6) AS total FROM per_batch"""
ORACLES["distill_loss"] = with_(VECTOR_LISTS, BATCH_LOSSES) + TOTALS
ORACLES["distil_text_loss"] = with_(
    DIALOGUE_LISTS,
    f"""text_batches AS (
  SELECT row_key, ({ranked('row_key', '42/0')}) // 16 AS batch_id FROM dialogues),
formatted AS (SELECT row_key, slot, 'query: (ko) ' || query AS query,
  'passage: (ko) ' || passage AS passage FROM candidates)""",
    encoded("eq", "SELECT DISTINCT row_key, query AS text FROM formatted"),
    encoded("ed", "SELECT DISTINCT md5(passage) AS row_key, passage AS text FROM formatted"),
    features("scored", "SELECT * FROM formatted"),
    """text_cosines AS (
  SELECT f.row_key, f.slot, sum(q.value * d.value) AS c FROM formatted f
  JOIN eq q ON q.row_key = f.row_key
  JOIN ed d ON d.row_key = md5(f.passage) AND d.lane = q.lane GROUP BY 1, 2),
score_lists AS (
  SELECT b.batch_id, s.row_key AS qid, s.slot, 1 / (1 + exp(-s.logit)) AS teacher,
    (coalesce(t.c, 0) + 1) / 2 AS student
  FROM scored s JOIN text_batches b ON b.row_key = s.row_key
  LEFT JOIN text_cosines t ON t.row_key = s.row_key AND t.slot = s.slot)""",
    BATCH_LOSSES,
) + TOTALS
ORACLES["bce_loss"] = with_(
    DOCS,
    LABELLED.format(t="docs"),
    features("scored", "SELECT *, query_text AS query, passage_text AS passage FROM labelled"),
) + """
SELECT round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 6) AS bce,
  count(*) AS n_rows FROM scored"""

ORACLES["epoch_loss"] = with_(BATCHES) + """
SELECT run_id, epoch, round(avg(loss) FILTER (phase = 'train' AND status = 'ok'), 6) AS train_loss,
  round(avg(loss) FILTER (phase = 'val' AND status = 'ok'), 6) AS val_loss,
  count(*) FILTER (phase = 'train' AND status = 'ok') AS n_processed,
  count(*) FILTER (status = 'skipped') AS n_skipped FROM batches GROUP BY 1, 2"""
ORACLES["epoch_loss_all_batches"] = with_(BATCHES) + """
SELECT run_id, epoch,
  round(coalesce(sum(loss) FILTER (phase = 'train'), 0)
    / nullif(count(*) FILTER (phase = 'train'), 0), 6) AS train_loss,
  round(coalesce(sum(loss) FILTER (phase = 'val'), 0)
    / nullif(count(*) FILTER (phase = 'val'), 0), 6) AS val_loss,
  count(*) FILTER (phase = 'train' AND status = 'ok') AS n_processed,
  count(*) FILTER (status = 'skipped') AS n_skipped FROM batches GROUP BY 1, 2"""
ORACLES["best_epoch"] = with_(EPOCHS) + """
SELECT run_id, epoch, val_loss FROM (SELECT *, row_number() OVER (
  PARTITION BY run_id ORDER BY val_loss, epoch) AS r FROM epochs WHERE val_loss IS NOT NULL)
WHERE r = 1"""
ORACLES["checkpoint_flags"] = with_(EPOCHS) + """
SELECT run_id, epoch, val_loss, least(before, val_loss) AS best_loss,
  val_loss IS NOT NULL AND (before IS NULL OR val_loss < before) AS save_model
FROM (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM epochs)"""

ORACLES["eval_report"] = with_(TEXT_SCORES, REPORT) + f"SELECT {REPORT_COLUMNS} FROM report"
ORACLES["vector_eval_report"] = (
    with_(VECTOR_SCORES, REPORT) + f"SELECT {REPORT_COLUMNS} FROM report"
)
ORACLES["eval_targets"] = with_(TEXT_SCORES, REPORT) + """
SELECT round(neg_cosine_similarity_mean, 6) AS neg_cosine_similarity_mean,
  round(margin_mean, 6) AS margin_mean,
  neg_cosine_similarity_mean <= 0.15 AS negative_ok, margin_mean >= 0.7 AS margin_ok FROM report"""
ORACLES["uniformity_bars"] = with_(TEXT_SCORES, REPORT) + """
SELECT 'positive' AS series, round(pos_uniformity, 6) AS variance FROM report
UNION ALL SELECT 'negative', round(neg_uniformity, 6) FROM report
UNION ALL SELECT 'overall', round(overall_uniformity, 6) FROM report"""

LONG = """long AS (SELECT 'positive' AS series, pos_score AS x FROM scores
  UNION ALL SELECT 'negative', neg_score FROM scores
  UNION ALL SELECT 'margin', margin FROM scores)"""
ORACLES["score_histogram"] = with_(VECTOR_SCORES, LONG) + """,
ends AS (SELECT series, min(x) AS lo, max(x) AS hi FROM long GROUP BY series),
limits AS (SELECT series, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
  CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM ends),
binned AS (SELECT l.series, least(49, floor((x - lo) / (hi - lo) * 50))::INTEGER AS bin
  FROM long l JOIN limits USING (series)),
counted AS (SELECT series, bin, count(*) AS c FROM binned GROUP BY 1, 2)
SELECT l.series, b.bin::INTEGER AS bin, round(lo + b.bin * ((hi - lo) / 50), 6) AS bin_from,
  round(lo + (b.bin + 1) * ((hi - lo) / 50), 6) AS bin_to, coalesce(c, 0) AS n_rows
FROM limits l, range(50) b(bin) LEFT JOIN counted c ON c.series = l.series AND c.bin = b.bin"""
QUARTILES = LONG + """,
quartiles AS (SELECT series, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
  quantile_cont(x, 0.75) AS q3 FROM long WHERE series <> 'margin' GROUP BY series),
fenced AS (SELECT l.series, x, q1, median, q3, q1 - 1.5 * (q3 - q1) AS fl, q3 + 1.5 * (q3 - q1) AS fh
  FROM long l JOIN quartiles USING (series))"""
ORACLES["score_boxplot"] = with_(VECTOR_SCORES, QUARTILES) + """
SELECT series, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3,
  round(least(any_value(q1), min(x) FILTER (x BETWEEN fl AND fh)), 6) AS whisker_low,
  round(greatest(any_value(q3), max(x) FILTER (x BETWEEN fl AND fh)), 6) AS whisker_high,
  count(*) FILTER (x < fl) AS n_low_outliers, count(*) FILTER (x > fh) AS n_high_outliers
FROM fenced GROUP BY series"""
ORACLES["score_outliers"] = with_(VECTOR_SCORES, QUARTILES) + """
SELECT series, round(x, 6) AS x FROM fenced WHERE x < fl OR x > fh"""
ORACLES["sample_scores"] = with_(TEXT_SCORES) + f"""
SELECT s.row_key, 'query: (ko) ' || d.anchor AS query_text,
  md5('passage: (ko) ' || d.positive) AS positive_text,
  md5('passage: (ko) ' || d.negative) AS negative_text, {SCORE_COLUMNS}
FROM scores s JOIN docs d ON d.row_key = s.row_key ORDER BY s.row_key LIMIT 5"""

ORACLES["log_rules"] = with_(LOG, FLAGS) + "SELECT * EXCLUDE (ts) FROM flags"
ORACLES["log_progress"] = with_(LOG) + r"""
SELECT * FROM (SELECT run_id, attempt, line_no, line,
  nullif(regexp_extract(line, '\[Epoch ([0-9]+)/([0-9]+)\]', 1), '')::BIGINT AS epoch,
  nullif(regexp_extract(line, '\[Epoch ([0-9]+)/([0-9]+)\]', 2), '')::BIGINT AS n_epochs,
  nullif(regexp_extract(line, '\[Train\] Loss: ([0-9]+[.]?[0-9]*)', 1), '')::DOUBLE AS train_loss,
  nullif(regexp_extract(line, 'Training: *([0-9]+)%', 1), '')::BIGINT AS percent,
  contains(line, 'Training:') AS is_progress FROM log)
WHERE is_progress OR epoch IS NOT NULL OR train_loss IS NOT NULL"""
ORACLES["log_tail"] = with_(LOG) + """
SELECT * FROM (SELECT run_id, attempt, line_no, line, row_number() OVER (
  PARTITION BY run_id, attempt ORDER BY line_no DESC)::INTEGER AS from_end FROM log)
WHERE from_end <= 50"""
ORACLES["log_complete"] = FINAL + "SELECT run_id, attempt, is_complete FROM statuses"
ORACLES["log_complete_reference"] = (
    FINAL_REFERENCE + "SELECT run_id, attempt, is_complete FROM statuses"
)
_ERRORS = """SELECT run_id, attempt, error_type, error_message FROM statuses
WHERE error_type IS NOT NULL"""
ORACLES["log_errors"] = FINAL + _ERRORS
ORACLES["log_errors_reference"] = FINAL_REFERENCE + _ERRORS
ORACLES["log_status"] = FINAL + """
SELECT run_id, attempt, last_line, status, error_type, error_message, progress FROM statuses"""
ORACLES["error_streaks"] = with_(POLLS) + """
SELECT run_id, attempt, poll, status, error_type, streak, streak >= 3 AS halted FROM streaks"""
ORACLES["monitor_batch"] = with_(POLLS) + "SELECT * FROM monitored"
ORACLES["missing_runs"] = with_(POLLS) + """,
newest AS (SELECT run_id, max(attempt) AS attempt FROM log GROUP BY run_id),
open_runs AS (
  SELECT run_id, attempt FROM newest n
  WHERE NOT EXISTS (SELECT 1 FROM stops t
    WHERE t.run_id = n.run_id AND t.attempt = n.attempt AND t.stop IS NOT NULL)),
silence AS (
  SELECT run_id, attempt, (SELECT floor(epoch(max(ts)))::BIGINT FROM events)
    - floor(epoch(max(ts)))::BIGINT AS silent_seconds
  FROM log JOIN open_runs USING (run_id, attempt) GROUP BY 1, 2)
SELECT run_id, attempt, silent_seconds, 'missing' AS status, 'restart' AS action
FROM silence WHERE silent_seconds > 10800"""
ORACLES["recovery_plan"] = with_(POLLS) + """,
base(name, setting) AS (VALUES ('data_version', 'supervised_only'), ('epochs', '3'),
  ('batch_size', '2'), ('lr', '2e-5'), ('K', '8'), ('tau', '0.2'),
  ('use_hard_negative_mining', 'True'), ('normalize_similarity', 'True'), ('lora_r', '32'),
  ('lora_alpha', '64'), ('lora_dropout', '0.1'), ('max_len', '256'), ('device', 'cuda')),
overrides(error_type, name, setting) AS (VALUES ('gpu_memory', 'batch_size', '1'),
  ('gpu_memory', 'K', '4'), ('cuda', 'device', 'cpu'))
SELECT m.run_id, m.attempt, m.poll, m.error_type, b.name, coalesce(o.setting, b.setting) AS setting
FROM monitored m CROSS JOIN base b
LEFT JOIN overrides o ON o.error_type = m.error_type AND o.name = b.name
WHERE m.status = 'error'"""
ORACLES["monitor_stream"] = FINAL + """
SELECT run_id, attempt, last_line, status, error_type, error_message, progress,
  CASE WHEN status = 'error' THEN 1 ELSE 0 END AS streak,
  CASE status WHEN 'complete' THEN 'evaluate' WHEN 'error' THEN 'recover' ELSE 'none' END AS action
FROM statuses s WHERE attempt = (SELECT max(attempt) FROM log l WHERE l.run_id = s.run_id)"""

ORACLES["eval_report_projected"] = ORACLES["eval_report"]
ORACLES["student_eval_report"] = ORACLES["vector_eval_report"]
ORACLES["fit_student"] = with_(VECTOR_LISTS, BATCH_LOSSES) + """
SELECT 'student' AS run_id, 'train' AS phase, 1::BIGINT AS epoch, 0::BIGINT AS batch_id,
  round(avg(kl + 0.3::DOUBLE * margin_loss + 0.4::DOUBLE * penalty), 6) AS loss, 'ok' AS status
FROM per_batch"""
ORACLES["fit_teacher"] = with_(
    DOCS,
    LABELLED.format(t="docs"),
    features("scored", "SELECT *, query_text AS query, passage_text AS passage FROM labelled"),
) + """
SELECT feature, round(mean, 3) AS mean FROM (
  SELECT 'jaccard' AS feature, avg(jaccard * label) AS mean FROM scored
  UNION ALL SELECT 'coverage', avg(coverage * label) FROM scored
  UNION ALL SELECT 'length_ratio', avg(length_ratio * label) FROM scored
  UNION ALL SELECT 'bias', avg(label) FROM scored)"""
ORACLES["fitted_teacher_scores"] = with_(DIALOGUE_LISTS) + """
SELECT row_key, slot::INTEGER AS slot, TRUE AS kept FROM candidates"""
