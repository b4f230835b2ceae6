"""SQL pieces for checking results in DuckDB.

They state what the operators mean by other means where there is a choice: undo and redo,
for one, are a recursive walk with stacks here and windows in Spark.
"""

from __future__ import annotations

from sessionloom import constants as C
from sessionloom.plans.views import LOG_SELECT


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(texts) -> str:
    return "(" + ", ".join(quoted(t) for t in texts) + ")"


LOG = "log0 AS (" + LOG_SELECT + ")"

_PREFIX = " OR ".join(f"starts_with(message, {quoted(p)})" for p in C.NOISE_PREFIXES)
_SUFFIX = " OR ".join(f"ends_with(message, {quoted(s)})" for s in C.NOISE_SUFFIXES)
_LIVE_SUFFIX = " OR ".join(f"ends_with(message, {quoted(s)})" for s in C.NOISE_SUFFIXES if s != C.BATCH_ONLY_SUFFIX)
LIVE_NOISE = f"({_PREFIX} OR {_LIVE_SUFFIX})"

PRE = LOG + f""",
pre AS (
  SELECT session, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts, seq, cat,
         regexp_replace(message, '\\(MAX-\\d+\\)', '', 'g') AS message
  FROM log0
  WHERE cat IN {any_of(C.LOG_CATEGORIES)} AND NOT ({_PREFIX})
    AND NOT (NOT starts_with(message, 'Menu:') AND ({_SUFFIX})))"""

KEPT = PRE + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS rn,
         CASE WHEN starts_with(message, 'End Event:') THEN 'event'
              WHEN starts_with(message, 'Undo Event: ') THEN 'undo'
              WHEN starts_with(message, 'Undo and Remove Action: ') THEN 'remove'
              WHEN starts_with(message, 'Redo Event:') THEN 'redo' END AS kind,
         trim(regexp_extract(message, ': (.+)$', 1)) AS cmd
  FROM pre),
walk AS (
  SELECT session, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(s BIGINT, c VARCHAR)[]) AS recent,
         CAST([] AS STRUCT(s BIGINT, c VARCHAR)[]) AS undone, CAST([] AS BIGINT[]) AS gone
  FROM (SELECT DISTINCT session FROM pre)
  UNION ALL
  SELECT session, rn,
    CASE WHEN kind = 'event' THEN list_append(recent, {'s': seq, 'c': cmd})
         WHEN kind IN ('undo', 'remove') AND hit IS NOT NULL THEN [x FOR x IN recent IF x.s <> hit]
         ELSE recent END,
    CASE WHEN kind = 'undo' AND hit IS NOT NULL THEN list_append(undone, {'s': hit, 'c': cmd})
         WHEN kind = 'redo' AND back IS NOT NULL THEN [x FOR x IN undone IF x.s <> back]
         ELSE undone END,
    CASE WHEN kind IN ('undo', 'remove') AND hit IS NOT NULL THEN list_append(gone, hit)
         WHEN kind = 'redo' AND back IS NOT NULL THEN [x FOR x IN gone IF x <> back]
         ELSE gone END
  FROM (SELECT w.session, n.rn, n.kind, n.cmd, n.seq, w.recent, w.undone, w.gone,
               list_last([x.s FOR x IN w.recent IF x.c = n.cmd]) AS hit,
               list_last([x.s FOR x IN w.undone IF x.c = n.cmd]) AS back
        FROM walk w JOIN numbered n ON n.session = w.session AND n.rn = w.rn + 1) step),
dead AS (
  SELECT session, unnest(gone) AS seq FROM (
    SELECT session, arg_max(gone, rn) AS gone FROM walk GROUP BY session) ends),
kept AS (
  SELECT session, ts, seq, cat, message FROM numbered n
  WHERE (kind IS NULL OR kind = 'event')
    AND NOT EXISTS (SELECT 1 FROM dead d WHERE d.session = n.session AND d.seq = n.seq))"""

ITEMS = KEPT + """,
items AS (
  SELECT *, regexp_replace(message, ' (\\(-?\\d+\\))+$', '') AS item FROM kept)"""

# Runs of equal neighbours as islands: position minus position within the item changes
# only when another item comes between.
MERGED = ITEMS + """,
flagged AS (
  SELECT *, CASE WHEN item = lag(item) OVER w THEN 0 ELSE 1 END AS fresh
  FROM items WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run
  FROM flagged),
merged AS (
  SELECT session, max(ts) AS ts, arg_max(seq, (ts, seq)) AS seq, arg_max(cat, (ts, seq)) AS cat,
         arg_max(message, (ts, seq)) AS message, any_value(item) AS item, count(*) AS merge_count
  FROM islands GROUP BY session, run)"""

DICT = KEPT + """,
words AS (SELECT DISTINCT message FROM kept),
dict_rows AS (
  SELECT message, CASE WHEN message LIKE 'Menu: M2%' THEN message || 'é' ELSE message END AS label, 2 AS seq
  FROM words WHERE message NOT LIKE 'Tool: T3%'
  UNION ALL SELECT message, 'old ' || message, 1 FROM words WHERE message LIKE 'End Event: E0%'),
dict0 AS (SELECT message, arg_max(label, seq) AS label FROM dict_rows GROUP BY message)"""

ALIGNED = DICT + """,
labelled AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) - 1 AS label_no FROM kept),
aligned AS (
  SELECT l.session, l.ts, l.seq, l.cat, l.message, l.label_no AS label, d.label AS message_eng
  FROM labelled l JOIN dict0 d ON d.message = l.message
  WHERE regexp_full_match(d.label, '[\\x20-\\x7e\\t\\n\\r\\x0b\\x0c]*'))"""

# The live chain up to the dictionary.  On this log the live noise rules keep the same rows
# as the batch rules (``prefilter_live_rules`` checks them by themselves).
LIVE = DICT + """,
live_rows AS (
  SELECT k.session, k.ts, k.seq, k.cat, row_number() OVER (PARTITION BY k.session ORDER BY k.ts, k.seq) - 1 AS label,
    coalesce(d.label, k.message) AS message_eng
  FROM kept k LEFT JOIN dict0 d ON d.message = k.message),
live AS (SELECT * FROM live_rows WHERE regexp_full_match(message_eng, '[\\x00-\\x7f]*'))"""

NEAR = ALIGNED + """,
commands AS (SELECT * FROM aligned WHERE cat IN ('Tool', 'Menu')),
candidates AS (
  SELECT c.session, c.label, c.message_eng AS command, e.message_eng AS event, e.label AS "at",
         e.ts >= c.ts AS later,
         row_number() OVER (PARTITION BY c.session, c.label, e.ts >= c.ts ORDER BY e.label) AS nth
  FROM commands c JOIN aligned e ON e.session = c.session AND e.cat = 'UNDO'
    AND e.label BETWEEN c.label - 10 AND c.label + 10),
near AS (SELECT * FROM candidates WHERE (later AND nth <= 3) OR (NOT later AND nth <= 1)),
sup AS (
  SELECT command, event, count(DISTINCT (session, label)) AS sup2 FROM near GROUP BY command, event),
support AS (
  SELECT s.command, s.event, c.sup1, s.sup2
  FROM sup s JOIN (SELECT message_eng AS command, count(*) AS sup1 FROM commands GROUP BY 1) c USING (command))"""


PAIRS = """,
pairs0 AS (SELECT * FROM (VALUES ('Tool: T0 (-20)', 'End Event: E0 (50)'), ('Tool: T1 (-21)', 'End Event: E1 (51)'),
  ('Menu: M0 - (30)', 'End Event: E0 (50)')) v(command, event))"""


def replaced(source: str, window: str) -> str:
    """The backward walk over the commands of each session, with the list of dropped labels;
    ``window`` limits which rows ``e`` a command ``c`` sees."""
    return PAIRS + f""",
visible AS (
  SELECT c.session, c.label, c.message_eng,
    list({{'l': e.label, 'm': e.message_eng}} ORDER BY e.label) FILTER (WHERE e.ts >= c.ts) AS later,
    list({{'l': e.label, 'm': e.message_eng}} ORDER BY e.label) FILTER (WHERE e.ts < c.ts) AS earlier
  FROM {source} c LEFT JOIN {source} e ON e.session = c.session AND e.cat = 'UNDO' AND {window}
  WHERE c.cat IN ('Tool', 'Menu') GROUP BY c.session, c.label, c.message_eng),
turns AS (
  SELECT v.*, p.events, row_number() OVER (PARTITION BY session ORDER BY label DESC) AS turn
  FROM visible v LEFT JOIN (SELECT command, list(event) AS events FROM pairs0 GROUP BY command) p ON p.command = v.message_eng),
back AS (
  SELECT session, CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS gone FROM (SELECT DISTINCT session FROM {source})
  UNION ALL
  SELECT session, turn, CASE WHEN len(near) > 0 AND events IS NULL THEN gone
      ELSE list_append(gone, coalesce(list_first([x.l FOR x IN near IF list_contains(events, x.m)]), label)) END
  FROM (SELECT b.session, t.turn, t.label, t.events, b.gone,
          list_concat(list_slice([x FOR x IN coalesce(t.later, []) IF NOT list_contains(b.gone, x.l)], 1, 5),
                      list_slice([x FOR x IN coalesce(t.earlier, []) IF NOT list_contains(b.gone, x.l)], 1, 1)) AS near
        FROM back b JOIN turns t ON t.session = b.session AND t.turn = b.turn + 1) s),
dropped AS (SELECT session, unnest(gone) AS label FROM (SELECT session, arg_max(gone, turn) AS gone FROM back GROUP BY session) g),
replaced AS (
  SELECT * FROM {source} a WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.session = a.session AND d.label = a.label))"""


def uniform(*parts: str) -> str:
    """The hashed uniform number of the library, from SQL expressions."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0)"


def hashed(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


# One pass of first-match merging as a walk over positions, then runs, times and codes.
LIVE_RESULT = LIVE + replaced("live", "true") + """,
line AS (
  SELECT session, ts, seq, cat, regexp_replace(message_eng, ' (\\(-?\\d+\\))+$', '') AS item,
    row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS p FROM replaced),
spans AS (
  SELECT *, CASE WHEN item = 'Tool: T1' AND lead(item) OVER w = 'End Event: E0' THEN 2
    WHEN item = 'Tool: T2' AND lead(item) OVER w = 'End Event: E1' AND lead(item, 2) OVER w = 'Tool: T2' THEN 3 ELSE 1 END AS size
  FROM line WINDOW w AS (PARTITION BY session ORDER BY p)),
hops AS (
  SELECT session, p, size, item FROM spans WHERE p = 1
  UNION ALL
  SELECT s.session, s.p, s.size, s.item FROM hops h JOIN spans s ON s.session = h.session AND s.p = h.p + h.size),
flow AS (
  SELECT h.session, l.ts, l.seq, h.p, CASE WHEN h.size > 1 THEN 'workflow' ELSE l.cat END AS cat,
    CASE h.size WHEN 2 THEN 'Tool: T1, End Event: E0' WHEN 3 THEN 'Tool: T2, End Event: E1, Tool: T2' ELSE h.item END AS item
  FROM hops h JOIN line l ON l.session = h.session AND l.p = h.p + h.size - 1),
fresh AS (
  SELECT *, CASE WHEN item = lag(item) OVER (PARTITION BY session ORDER BY p) THEN 0 ELSE 1 END AS f FROM flow),
runs AS (SELECT *, sum(f) OVER (PARTITION BY session ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM fresh),
ends AS (
  SELECT session, max(ts) AS timestamp, arg_max(seq, p) AS seq, arg_max(cat, p) AS cat, any_value(item) AS item, count(*) AS merge_count
  FROM runs GROUP BY session, run),
timed AS (
  SELECT *, timestamp - coalesce(lag(timestamp) OVER (PARTITION BY session ORDER BY timestamp, seq), timestamp) AS timestamp_interval FROM ends),
words_of AS (SELECT DISTINCT regexp_replace(message, ' (\\(-?\\d+\\))+$', '') AS item FROM kept),
live_result AS (
  SELECT session, timestamp, seq, cat, coalesce(length(w.item), -1)::BIGINT AS item_id, merge_count, timestamp_interval,
    split_part(t.item, ':', 1) AS classification, right(t.item, 2) AS target
  FROM timed t JOIN words_of w ON w.item = t.item WHERE t.item NOT IN ('Tool: T3', 'Tool: T2'))"""
