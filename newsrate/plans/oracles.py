"""The same queries as SQL over the raw tables, written independently for the result check."""

from __future__ import annotations

from newsrate.functions.text import REPLY_START, WHITESPACE
from newsrate.plans import views
from newsrate.schemas import NEWS_COLUMNS

NOT_WORD = r"[^\p{L}\p{N}_]"


def _words(words) -> str:
    return rf"(?i)(^|{NOT_WORD})({'|'.join(w for w in words if w)})($|{NOT_WORD})"


def _chars(s: str) -> str:
    return "||".join(f"chr({ord(c)})" for c in s)


def _keyword(col: str) -> str:
    return f"regexp_extract({col}, '{_words(views.STAND_IN)}', 2)"


def _listed(col: str) -> str:
    return f"regexp_extract({col}, '{_words(views.LONG_LIST)}', 2)"


def _listed_pair(col: str) -> str:
    return f"nullif(upper(replace({_listed(col)}, ' ', '-')) || '/USDT', '/USDT')"


def _pair(col: str) -> str:
    return f"(CASE WHEN {_keyword(col)} <> '' THEN upper({_keyword(col)}) || '/USDT' END)"


def _sanitize(col: str) -> str:
    return f"replace(replace({col}, ',', ' '), '\"', '')"


def _plain(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        x = f"replace({x}, '&{entity};', '{char}')"
    return x


RATE = """(CASE WHEN up_count + down_count = 0 THEN 0
  WHEN up_count::DOUBLE / (up_count + down_count) > 0.9 THEN 2
  WHEN up_count::DOUBLE / (up_count + down_count) > 0.6 THEN 1
  WHEN up_count::DOUBLE / (up_count + down_count) > 0.45 THEN 0
  WHEN up_count::DOUBLE / (up_count + down_count) > 0.15 THEN -1 ELSE -2 END)::INTEGER"""
TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
INPUT_TIME = TIME.format("inputtime")
TRADE_PAIR = f"coalesce({_pair('title')}, {_pair('description')}, '')"
LINE = "translate({}, chr(10) || chr(13), '  ')"

NEWS = """news AS (
  SELECT doc_id AS id,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 2591) % 2592000) AS inputtime,
    split_part(text, chr(10), 1) AS title,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS description,
    ((doc_id * 7919) % 23)::INTEGER AS up_count, ((doc_id * 104729) % 11)::INTEGER AS down_count,
    n_chars AS hits, source || '/' || doc_id AS url,
    ['view', 'click', 'error', 'signup', 'purchase'][doc_id % 5 + 1] AS sym, lang, source
  FROM documents)"""
NEWS_LIST = ", ".join(NEWS_COLUMNS)
NEWS_TEXT_TIME = NEWS_LIST.replace("inputtime", f"{INPUT_TIME} AS inputtime")

FEED = (
    NEWS
    + """, placed AS (
  SELECT *, id // 20 AS p, row_number() OVER (PARTITION BY id // 20 ORDER BY id) - 1 AS pos
  FROM news), cut AS (SELECT max(p) * 9 // 10 AS c FROM placed),
failed AS (SELECT p FROM placed WHERE pos < 2 AND lang = 'de' GROUP BY p HAVING count(*) = 2),
feed AS (
  SELECT p + CASE WHEN p >= c THEN 1 ELSE 0 END AS page,
    (CASE WHEN p IN (SELECT p FROM failed) THEN 500 ELSE 200 END)::INTEGER AS status, c, placed.*
  FROM placed, cut)"""
)
FEED_ITEM = f"""id, {INPUT_TIME} AS inputtime, {_sanitize('title')} AS title,
  {_sanitize('description')} AS description, up_count, down_count, hits, url"""

STORED = f"""stored AS (
  SELECT {NEWS_LIST}, 'OLD/USDT' AS tp, quality::INTEGER AS rate, 2 AS cat
  FROM news JOIN labels ON labels.doc_id = news.id)"""
LABELLED = f"""labelled AS (
  SELECT {NEWS_LIST}, {TRADE_PAIR} AS tp, {RATE} AS rate, 1 AS cat FROM news)"""
FRESH = "labelled WHERE id NOT IN (SELECT doc_id FROM labels)"

RAW_LINES = f"lines AS (SELECT {LINE.format('text')} AS value FROM documents)"
FIELDS = "fields AS (SELECT value, string_split(value, ',') AS f, len(string_split(value, ',')) AS n FROM lines)"


def _repaired(tail: int) -> str:
    width = 4 + tail
    return f"""CASE WHEN n > {width} THEN array_to_string(f[1:3], ',') || ',' ||
      array_to_string(f[4:n - {tail}], ' ') || ',' || array_to_string(f[n - {tail} + 1:n], ',')
    WHEN n = {width} THEN value END"""


def _middle(tail: int, width: int) -> str:
    return f"""CASE WHEN n > {width} THEN array_to_string(f[4:n - {tail}], ',')
    WHEN n = {width} THEN f[4] END"""


def _bars(seconds: int) -> str:
    return (
        NEWS
        + f""", joined AS (
  SELECT n.id, n.sym, count(b.ts) AS n_bars, min(b.ts) AS first_time, max(b.ts) AS last_time,
    arg_min(1000.0::DOUBLE + b.value, b.ts) AS first_open,
    max(1000.0::DOUBLE + b.value) AS high, min(1000.0::DOUBLE + b.value) AS low
  FROM news n LEFT JOIN events b ON b.event_type = n.sym
    AND b.ts BETWEEN n.inputtime AND n.inputtime + INTERVAL {seconds} SECOND
  GROUP BY n.id, n.sym), moves AS (
  SELECT *, (high - first_open) / first_open AS rise, (first_open - low) / first_open AS drop_
  FROM joined)"""
    )


PRICE_RATE = """(CASE WHEN rise IS NULL THEN NULL
  WHEN rise > 0.075 AND drop_ > 0.075 THEN CASE WHEN drop_ < rise THEN 2 ELSE -2 END
  WHEN rise > 0.075 THEN 2 WHEN drop_ > 0.075 THEN -2
  WHEN rise > 0.01 AND drop_ > 0.01 THEN CASE WHEN drop_ < rise THEN 1 ELSE -1 END
  WHEN rise > 0.01 THEN 1 WHEN drop_ > 0.01 THEN -1 ELSE 0 END)::INTEGER"""

ARTICLE = r"'(?s)<article\b.*?</article>'"
BLOCKS = r"regexp_extract_all(post, '(?s)<p\b[^>]*>(.*?)</p>', 1)"
POST_RAW = f"""blocks AS (
  SELECT page_id AS seq, url AS href,
    {BLOCKS.replace('post', f'regexp_extract(html, {ARTICLE}, 0)')} AS b,
    regexp_matches(url, '^https?://m[.]') AS reply FROM pages), post_raw AS (
  SELECT seq, href, CASE WHEN reply THEN '{REPLY_START}' || {_plain('b[1]')}
    ELSE {_plain('b[1]')} END AS first, {_plain('b[2]')} AS second,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(seq * 3600) AS posted FROM blocks), bodies AS (
  SELECT *, CASE WHEN starts_with(first, '{REPLY_START}') THEN second ELSE first END AS body
  FROM post_raw)"""
TAIL_ID = "regexp_extract({}, '[0-9]+$')"
HOST = "nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '')"


def _tokens(source: str, key: str, text: str) -> str:
    found = (
        f"regexp_extract_all(regexp_replace(lower({text}), '(\\p{{Han}})', ' \\1 ', 'g'),"
        " '[\\p{L}\\p{N}_]+')"
    )
    return f"""found AS (SELECT {key} AS k, {found} AS list FROM {source}), tok AS (
  SELECT k, unnest(list) AS token, unnest(range(1, len(list) + 1)) AS pos FROM found)"""


VOCAB = """vocab AS (
  SELECT token, 105 + row_number() OVER (ORDER BY n DESC, token) AS token_id FROM (
    SELECT token, count(*) AS n FROM {tok} GROUP BY token ORDER BY n DESC, token))"""
CODED = """coded AS (
  SELECT k, list(coalesce(token_id, 100) ORDER BY pos) AS ids
  FROM tok LEFT JOIN vocab USING (token) WHERE pos <= 254 GROUP BY k)"""
PADDED = "array_to_string(list_resize([101] || coalesce(ids, []) || [102], 256, 0), ' ')"


def _heads(epochs) -> str:
    rows = []
    for e in epochs:
        weights = ", ".join(
            f"list_dot_product(embedding::DOUBLE[], {w}::DOUBLE[])" for w in views.head_weights(e)
        )
        rows.append(f"SELECT {e} AS epoch, vec_id, label, [{weights}] AS z FROM embeddings")
    return f"""heads AS ({' UNION ALL '.join(rows)}), exps AS (
  SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM heads), probs AS (
  SELECT epoch, vec_id, label, z, list_transform(e, lambda x: x / list_sum(e)) AS p FROM exps)"""


PREDS = (
    _heads(range(1, views.HEAD_EPOCHS + 1))
    + """, preds AS (
  SELECT epoch, CASE WHEN label < 5 THEN 'train' ELSE 'valid' END AS split, vec_id AS pos, p,
    label % 5 AS y, -ln(p[label % 5 + 1]) AS loss,
    (list_position(p, list_max(p)) - 1 = label % 5)::INTEGER AS hit FROM probs), numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY epoch, split ORDER BY pos) - 1) // 4 AS batch
  FROM preds), batches AS (
  SELECT epoch, split, batch, avg(hit) AS acc, avg(loss) AS loss, count(*) AS n
  FROM numbered GROUP BY ALL), epochs AS (
  SELECT epoch, split, avg(acc) AS acc, avg(loss) AS loss, sum(acc * n) / sum(n) AS row_acc,
    sum(loss * n) / sum(n) AS row_loss FROM batches GROUP BY ALL), running AS (
  SELECT epoch, acc, coalesce(max(acc) OVER (ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS best_before
  FROM epochs WHERE split = 'valid')"""
)

ORACLES: dict[str, str] = {
    "scan_project": f"WITH {NEWS} SELECT {NEWS_TEXT_TIME} FROM news",
    "csv_news": f"""WITH {NEWS} SELECT id, {INPUT_TIME} AS inputtime, nullif(title, '') AS title,
        nullif(description, '') AS description, up_count, down_count, hits, url, 'ok' AS status,
        NULL AS value FROM news UNION ALL
        SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'record',
        concat_ws(',', id, up_count, hits) FROM news""",
    "line_scan": f"WITH {RAW_LINES} SELECT value FROM lines",
    "marked_scan": f"""WITH {NEWS} SELECT title,
        {LINE.format(_sanitize('description'))} AS description, sym AS tp,
        (CASE WHEN up_count + down_count = 0 THEN 0 WHEN up_count > 20 THEN NULL
          ELSE up_count % 7 - 3 END)::INTEGER AS rate, 'ok' AS status, NULL AS value
        FROM news WHERE NOT contains(title, ',') UNION ALL
        SELECT NULL, NULL, NULL, NULL, 'width', concat_ws(',', id, {INPUT_TIME}, title,
          {LINE.format(_sanitize('description'))}, up_count, down_count, hits, url, 0, sym,
          CASE WHEN up_count + down_count = 0 THEN '' WHEN up_count > 20 THEN 'x'
            ELSE (up_count % 7 - 3) || '.9' END, 1) FROM news WHERE contains(title, ',')""",
    "feed_explode": f"""WITH {FEED} SELECT page, status, pos::INTEGER AS pos, id,
        epoch(inputtime)::BIGINT::VARCHAR AS inputtime, title, description, up_count, down_count,
        hits, url FROM feed""",
    "bars_parse": """SELECT event_type AS symbol, epoch_us(ts) // 1000 AS open_ms,
        round(1000.0::DOUBLE + value, 6) AS open, round(1000.0::DOUBLE + value, 6) AS high,
        round(1000.0::DOUBLE + value, 6) AS low FROM events""",
    "page_extract": rf"""SELECT page_id, {TAIL_ID.format('url')} AS tail_id, {HOST} AS host,
        {_plain("nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '')")} AS title
        FROM pages""",
    "page_posts": f"""WITH found AS (SELECT page_id AS page,
          regexp_extract_all(html, {ARTICLE}) AS list FROM pages), posts AS (
          SELECT page, unnest(list) AS post, unnest(range(0, len(list))) AS seq FROM found)
        SELECT page, seq::INTEGER AS seq, {_plain(f'({BLOCKS})[1]')} AS first,
          {_plain(f'({BLOCKS})[2]')} AS second FROM posts""",
    "hash_split": """SELECT doc_id AS id, CASE WHEN
        ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 >= 1 THEN 'train'
        ELSE 'valid' END AS split FROM documents""",
    "insert_if_absent": f"""WITH {NEWS}, {STORED}, {LABELLED}, loaded AS (
          SELECT * FROM stored UNION ALL SELECT * FROM {FRESH})
        SELECT {NEWS_TEXT_TIME}, tp, rate, cat FROM loaded""",
    "insert_count": """SELECT count(*) AS inserted FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "csv_append": f"""WITH {NEWS} SELECT id::VARCHAR AS id, NULL::VARCHAR AS time,
        nullif(title, '') AS title, risk FROM news, (VALUES ('0'), (NULL)) AS t(risk)""",
    "text_append": f"""WITH {RAW_LINES}, {FIELDS}
        SELECT coalesce({_repaired(4)}, value) AS value FROM fields""",
    "epoch_text": f"WITH {NEWS} SELECT id, {INPUT_TIME} AS time FROM news",
    "event_window": f"""WITH {NEWS} SELECT id, epoch(inputtime)::BIGINT * 1000 AS start_ms,
        (epoch(inputtime)::BIGINT + 1200) * 1000 AS end_ms FROM news""",
    "sanitize": f"SELECT doc_id, {_sanitize('text')} AS clean FROM documents",
    "split_fields": f"""WITH parts AS (SELECT doc_id,
          string_split(trim(text, {_chars(WHITESPACE)}), ',') AS f FROM documents)
        SELECT doc_id, len(f)::INTEGER AS n_fields, f[1] AS first_field, f[len(f)] AS last_field
        FROM parts""",
    "repair_row": f"""WITH {RAW_LINES}, {FIELDS} SELECT value, {_repaired(4)} AS repaired,
        {_middle(5, 8)} AS short_middle FROM fields""",
    "repair_row_12": f"""WITH {RAW_LINES}, {FIELDS} SELECT value, {_repaired(8)} AS repaired,
        {_middle(8, 12)} AS middle FROM fields""",
    "first_keyword": f"""WITH {NEWS} SELECT id, {_keyword('title')} AS title_word,
        {_keyword('description')} AS description_word FROM news""",
    "keyword_pair": f"""WITH {NEWS} SELECT id, {_keyword('description')} AS keyword,
        {_pair('description')} AS pair, {_pair('description')} AS mapped FROM news""",
    "lexicon_pairs": f"""WITH {NEWS} SELECT id, {_pair('description')} AS pair FROM news
        WHERE {_keyword('description')} <> ''""",
    "keyword_list": f"""WITH {NEWS} SELECT id, {_listed('description')} AS keyword,
        coalesce({_listed_pair('title')}, {_listed_pair('description')}, '') AS tp,
        {_listed('title')} <> '' AS in_title FROM news""",
    "trade_pair": f"""WITH {NEWS} SELECT id, {TRADE_PAIR} AS tp,
        coalesce({_pair('title')}, '') AS tp_compat FROM news""",
    "vote_ratio": f"""WITH {NEWS} SELECT id, CASE WHEN up_count + down_count > 0 THEN
        round(up_count::DOUBLE / (up_count + down_count), 6) END AS ratio FROM news""",
    "vote_rating": f"WITH {NEWS} SELECT id, {RATE} AS rate FROM news",
    "label_index": f"""WITH {NEWS} SELECT id, ({RATE} + 2)::INTEGER AS label,
        (CASE WHEN up_count BETWEEN 8 AND 12 THEN up_count - 8 END)::INTEGER AS other_label
        FROM news""",
    "trunc_int": """SELECT event_id, (CASE event_type WHEN 'view' THEN trunc(value)
        WHEN 'click' THEN -trunc(value) WHEN 'error' THEN 0 WHEN 'signup' THEN NULL
        ELSE event_id END)::INTEGER AS n FROM events""",
    "price_move": f"""WITH {_bars(1200)} SELECT id, round(rise, 6) AS rise,
        round(drop_, 6) AS "drop" FROM moves""",
    "price_rating": f"WITH {_bars(21600)} SELECT id, {PRICE_RATE} AS rate FROM moves",
    "url_part": rf"""SELECT page_id, {HOST} AS host,
        nullif(regexp_extract(url, 'example\.com/([^/]+)', 1), '') AS "user" FROM pages""",
    "url_tail_id": f"SELECT page_id, {TAIL_ID.format('url')} AS tail_id FROM pages",
    "reply_body": f"WITH {POST_RAW} SELECT seq, body FROM bodies",
    "iso_plain": f"WITH {POST_RAW} SELECT seq, {TIME.format('posted')} AS time FROM post_raw",
    "encode_text": f"""WITH {_tokens('documents', 'doc_id', 'text')},
        {VOCAB.format(tok='tok')}, {CODED}
        SELECT doc_id, coalesce(len(list), 0)::INTEGER AS n_tokens, {PADDED} AS input_ids, (len(coalesce(ids, [])) + 2)::INTEGER AS n_ids,
          0 AS max_type FROM documents LEFT JOIN coded ON coded.k = doc_id
          LEFT JOIN found ON found.k = doc_id""",
    "linear_head": f"WITH {_heads([1])} SELECT vec_id, "
    + ", ".join(f"round(z[{k + 1}], 6) AS z{k}" for k in range(5))
    + " FROM probs",
    "softmax": f"WITH {_heads([1])} SELECT vec_id, "
    + ", ".join(f"round(p[{k + 1}], 6) AS p{k}" for k in range(5))
    + " FROM probs",
    "argmax_label": f"""WITH {_heads([1])}
        SELECT vec_id, (list_position(z, list_max(z)) - 1)::INTEGER AS class_index,
        (list_position(z, list_max(z)) - 3)::INTEGER AS rate FROM probs""",
    "head_scoring": f"""WITH {_heads([1])}
        SELECT vec_id, (list_position(p, list_max(p)) - 3)::INTEGER AS rate,
        round(list_max(p), 6) AS confidence FROM probs""",
    "cross_entropy": f"""WITH {PREDS} SELECT epoch, pos, round(loss, 6) AS loss,
        round(ln(list_sum(list_transform(p, lambda x: exp(x)))) - p[y + 1], 6) AS loss_compat
        FROM preds""",
    "keyword_filter": rf"""SELECT doc_id, 'intended' AS mode FROM documents
        WHERE regexp_matches(text, '{_words(views.POST_TERMS)}') UNION ALL
        SELECT doc_id, 'compat' FROM documents WHERE regexp_matches(text, '[\p{{L}}\p{{N}}_]')""",
    "since_cutoff": f"""WITH {NEWS} SELECT id, {INPUT_TIME} AS inputtime FROM news
        WHERE inputtime > TIMESTAMP '{views.CUTOFF}'""",
    "take_while": f"""WITH {NEWS}, fed AS (
          SELECT *, row_number() OVER (ORDER BY id // 20 DESC, id) AS n FROM news)
        SELECT id, {INPUT_TIME} AS inputtime FROM fed WHERE n < (
          SELECT coalesce(min(n), 9223372036854775807) FROM fed
          WHERE inputtime <= TIMESTAMP '{views.EARLY}')""",
    "until_empty_page": f"""WITH {FEED} SELECT page, count(*)::INTEGER AS n_items FROM feed
        WHERE status = 200 AND page < c GROUP BY page
        UNION ALL SELECT c // 2, NULL FROM cut""",
    "feed_quarantine": f"""WITH {FEED} SELECT page, 'body' AS status FROM feed
        WHERE status = 200 AND page < c AND page % 7 = 3 GROUP BY page
        UNION ALL SELECT c // 2, CASE WHEN c // 2 % 7 = 3 THEN 'body' ELSE 'data' END FROM cut""",
    "fit_and_score": f"""WITH {NEWS} SELECT id, ({RATE} + 2)::INTEGER AS truth,
        TRUE AS saved_equals_fitted, 1.0::DOUBLE AS total FROM news
        WHERE ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % 10 < 1""",
    "train_epochs": "SELECT unnest([1, 2, 3])::INTEGER AS epoch, TRUE AS better",
    "batch_score": f"""WITH {NEWS}, lines AS (
          SELECT id, {INPUT_TIME} AS time, replace({_sanitize('title')}, chr(13), ' ') AS title,
            {LINE.format('description')} AS body, up_count, down_count, hits, url FROM news)
        SELECT concat_ws(',', id, time, title, body, up_count, down_count, hits, url) AS value,
          {_pair('body')} AS tp, TRUE AS known_label FROM lines WHERE {_keyword('body')} <> ''""",
    "tradable_news": f"WITH {NEWS}, {LABELLED} SELECT id, tp FROM labelled WHERE tp <> ''",
    "alerts": f"WITH {NEWS}, {LABELLED} SELECT id, tp, rate FROM labelled WHERE rate <> 0",
    "author_range": f"""WITH {NEWS} SELECT id, inputtime::DATE::VARCHAR AS date FROM news
        WHERE source = 'src1' AND lang <> 'de' AND inputtime::DATE >= DATE '2024-01-05'
        AND inputtime::DATE < DATE '2024-01-20'""",
    "no_result_pages": "SELECT page_id FROM pages WHERE NOT contains(html, 'nicht')",
    "quarantine": f"""WITH {NEWS} SELECT id, CASE WHEN contains(title, ',') THEN 'width'
        WHEN up_count + down_count = 0 THEN 'ok' WHEN up_count > 20 THEN 'rate'
        WHEN abs(up_count % 7 - 3) > 2 THEN 'label' ELSE 'ok' END AS status FROM news""",
    "interval_join": f"""WITH {_bars(1200)} SELECT id, sym AS symbol, n_bars,
        epoch_us(first_time) AS first_us, epoch_us(last_time) AS last_us FROM joined""",
    "first_bar_after": f"""WITH {_bars(1200)} SELECT id, epoch_us(first_time) AS first_us,
        round(first_open, 6) AS first_open FROM joined""",
    "bar_summary": f"""WITH {_bars(1200)} SELECT id, round(first_open, 6) AS first_open,
        round(high, 6) AS high, round(low, 6) AS low, n_bars FROM joined""",
    "batch_number": """SELECT doc_id AS id, lang,
        (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 4 AS batch
        FROM documents""",
    "batch_metrics": f"""WITH {PREDS} SELECT epoch, split, batch, round(acc, 6) AS acc,
        round(loss, 6) AS loss, n FROM batches""",
    "epoch_metrics": f"""WITH {PREDS} SELECT epoch, split, round(acc, 6) AS acc,
        round(loss, 6) AS loss, round(row_acc, 6) AS row_acc, round(row_loss, 6) AS row_loss
        FROM epochs""",
    "best_epoch": f"""WITH {PREDS} SELECT epoch, round(acc, 6) AS acc FROM epochs
        WHERE split = 'valid' AND acc > 0 ORDER BY epochs.acc DESC, epoch LIMIT 1""",
    "running_best": f"""WITH {PREDS} SELECT epoch, round(acc, 6) AS acc,
        round(best_before, 6) AS best_before, running.acc > best_before AS improved
        FROM running""",
    "dataset_size": f"""WITH {NEWS} SELECT count(*) AS n_rows, count(DISTINCT {RATE}) AS n_classes
        FROM news""",
    "dedup_posts": """SELECT conv_id, turn, role, text FROM conversations QUALIFY
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1""",
    "seeded_shuffle": "SELECT doc_id AS id, md5(doc_id || ':7') AS shuffle_key FROM documents",
    "union_pages": """SELECT 'documents' AS origin, doc_id AS key, text FROM documents UNION ALL
        SELECT 'conversations', conv_id, text FROM conversations UNION ALL
        SELECT 'benchmark', item_id, text FROM benchmark""",
    "label_by_votes": f"""WITH {NEWS}, {LABELLED}
        SELECT {NEWS_TEXT_TIME}, tp, rate, cat FROM {FRESH}""",
    "mark_rows": f"""WITH {NEWS}, tagged AS (SELECT *, {_pair('description')} AS tp FROM news),
        bars AS (SELECT *, 1000.0::DOUBLE + value AS price, CASE event_type """
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in views.MARKET.items())
    + f""" END AS symbol FROM events), joined AS (
          SELECT n.id, count(b.ts) AS n_bars, arg_min(price, b.ts) AS o, max(price) AS h,
            min(price) AS l
          FROM tagged n LEFT JOIN bars b ON b.symbol = replace(n.tp, '/', '')
            AND b.ts BETWEEN n.inputtime AND n.inputtime + INTERVAL 1200 SECOND
          GROUP BY n.id), moves AS (
          SELECT id, n_bars, (h - o) / o AS rise, (o - l) / o AS drop_ FROM joined)
        SELECT id, {INPUT_TIME} AS time, title, description, up_count, down_count, hits, url,
          0 AS risk, tp, {PRICE_RATE} AS rate, 1 AS cat,
          CASE WHEN n_bars = 0 THEN 'no_bars' ELSE 'rated' END AS status
        FROM tagged JOIN moves USING (id) WHERE tp IS NOT NULL""",
    "ingest_feed": f"""WITH {FEED} SELECT {FEED_ITEM} FROM feed
        WHERE status = 200 AND page < c AND inputtime > TIMESTAMP '{views.CUTOFF}'""",
    "post_clean": f"""WITH {POST_RAW}, firsts AS (
          SELECT *, {TAIL_ID.format('href')} AS tweet_id FROM bodies WHERE
          {TAIL_ID.format('href')} <> '' QUALIFY row_number() OVER (
            PARTITION BY {TAIL_ID.format('href')} ORDER BY seq) = 1)
        SELECT tweet_id, body AS text, {TIME.format('posted')} AS time FROM firsts
        WHERE regexp_matches(body, '{_words(views.POST_TERMS)}')""",
    "training_set": f"""WITH {NEWS}, {_tokens('news', 'id', 'title')},
        {VOCAB.format(tok='tok')}, {CODED}
        SELECT {_sanitize('title')} AS text, ({RATE} + 2)::INTEGER AS label,
          {PADDED} AS input_ids, 'ok' AS status, NULL AS value
        FROM news LEFT JOIN coded ON k = id UNION ALL
        SELECT NULL, NULL, NULL, CASE WHEN len(f) <> 8 THEN 'width' ELSE 'int' END, value FROM (
          SELECT *, string_split(value, ',') AS f FROM (
            SELECT {LINE.format('text')} AS value FROM documents))""",
    "stream_ingest": f"""WITH {FEED} SELECT {FEED_ITEM} FROM feed
        WHERE status = 200 AND page < c AND inputtime > TIMESTAMP '{views.CUTOFF}'""",
    "stream_dedup": "SELECT doc_id AS id FROM documents",
    "stream_insert": f"""WITH {NEWS}, {STORED}, {LABELLED}, loaded AS (
          SELECT * FROM stored UNION ALL SELECT * FROM {FRESH})
        SELECT {NEWS_TEXT_TIME}, tp, rate, cat FROM loaded""",
    "stream_label": f"WITH {NEWS}, {LABELLED} SELECT {NEWS_TEXT_TIME}, tp, rate, cat FROM labelled",
    "stream_interval": f"""WITH {_bars(1200)} SELECT id, round(first_open, 6) AS first_open,
        round(high, 6) AS high, round(low, 6) AS low, n_bars, {PRICE_RATE} AS rate FROM moves""",
}
