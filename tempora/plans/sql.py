"""Parts of the SQL that several queries share; each reads the views of ``fixtures`` by their names."""

from __future__ import annotations

CROSS = """cross_ids AS (SELECT DISTINCT a.track_id, a.id FROM cues a JOIN cues b ON a.track_id = b.track_id AND a.speaker <> b.speaker
  AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms)"""
MERGED = """merged AS (SELECT track_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(CASE WHEN start_ms > reach + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, max(end_ms) OVER (PARTITION BY track_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE end_ms >= start_ms)) GROUP BY track_id, island)"""
MERGED40 = MERGED.replace("reach + 10", "reach + 40")
#: cues aligned to the merged spans
ALIGNED = f"""{CROSS}, {MERGED40}, p AS (SELECT *, lag(end_ms) OVER (PARTITION BY track_id ORDER BY ordinal) AS prev FROM cues),
speaking AS (SELECT DISTINCT c.track_id, c.id FROM cues c JOIN merged v ON c.track_id = v.track_id AND v.start_ms <= c.start_ms + 40 AND v.end_ms >= c.start_ms - 40 AND v.end_ms - c.start_ms > 800),
candidates AS (SELECT p.track_id, p.id, min(v.start_ms) AS candidate FROM p JOIN merged v ON p.track_id = v.track_id AND v.end_ms >= p.start_ms - 40 AND v.start_ms <= least(p.end_ms, p.start_ms + 2000)
  AND (prev IS NULL OR v.start_ms >= prev + 40) GROUP BY 1, 2),
found AS (SELECT cues.*, x.id IS NOT NULL AS frozen, CASE WHEN s.id IS NOT NULL THEN start_ms WHEN candidate IS NOT NULL THEN greatest(candidate, start_ms) END AS spoken FROM cues LEFT JOIN cross_ids x USING (track_id, id)
  LEFT JOIN speaking s USING (track_id, id) LEFT JOIN candidates USING (track_id, id)),
started AS (SELECT *, CASE WHEN frozen OR spoken IS NULL THEN start_ms ELSE least(spoken, end_ms) END AS new_start,
  CASE WHEN frozen THEN NULL WHEN spoken IS NULL THEN 0.35::DOUBLE WHEN spoken > start_ms + 20 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM found),
n AS (SELECT *, lead(new_start) OVER (PARTITION BY track_id ORDER BY ordinal) AS nx FROM started),
refined AS (SELECT track_id, id, r FROM (SELECT n.track_id, n.id, v.end_ms AS r, row_number() OVER (PARTITION BY n.track_id, n.id ORDER BY abs(v.end_ms - n.end_ms), v.end_ms DESC) AS k
  FROM n JOIN merged v ON n.track_id = v.track_id AND abs(v.end_ms - n.end_ms) <= 1000 AND v.start_ms <= n.end_ms + 40 AND v.end_ms >= new_start AND (nx IS NULL OR v.end_ms <= nx)) WHERE k = 1),
aligned AS (SELECT track_id, id, ordinal, new_start AS start_ms, CASE WHEN frozen THEN end_ms ELSE greatest(new_start, coalesce(r, end_ms)) END AS end_ms, speaker, source, confidence FROM n LEFT JOIN refined USING (track_id, id))"""
SILENCES = """silences AS (SELECT track_id, ordinal, gap_ms FROM (SELECT track_id, ordinal, lead(start_ms) OVER (PARTITION BY track_id ORDER BY ordinal)
  - max(end_ms) OVER (PARTITION BY track_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS gap_ms FROM words) WHERE gap_ms >= 800)"""
MISSING = """batches AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY min(ordinal)) - 1 AS batch_no, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n FROM (
  SELECT *, (row_number() OVER (PARTITION BY track_id, run ORDER BY ordinal) - 1) // 20 AS part FROM (
    SELECT track_id, ordinal, ordinal - row_number() OVER (PARTITION BY track_id ORDER BY ordinal) AS run FROM cues WHERE coalesce(translated, '') = '')) GROUP BY track_id, run, part)"""


def word_batches(target: int, words: str = "words", key: str = "track_id") -> str:
    """Steps up to ``walk`` (key, batch_no, first, last, forced_end): the batches of ``words`` by key, from cut to cut. They need WITH RECURSIVE."""
    hard, base = 2 * target, 10**8
    return f"""silent AS (SELECT {key}, ordinal, CASE WHEN g >= 800 THEN g END AS gap FROM (SELECT {key}, ordinal, lead(start_ms) OVER (PARTITION BY {key} ORDER BY ordinal)
  - max(end_ms) OVER (PARTITION BY {key} ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS g FROM {words})),
near AS (SELECT *, row_number() OVER o - 1 AS place, count(*) OVER (PARTITION BY {key}) AS n, max(ordinal) OVER (PARTITION BY {key}) AS top,
  max(gap * {base} - ordinal) OVER (PARTITION BY {key} ORDER BY ordinal ROWS BETWEEN {target // 2 - 1} FOLLOWING AND {target - 1} FOLLOWING) AS widest,
  min(CASE WHEN gap IS NOT NULL THEN ordinal END) OVER (PARTITION BY {key} ORDER BY ordinal ROWS BETWEEN {target} FOLLOWING AND {hard - 2} FOLLOWING) AS later
  FROM silent WINDOW o AS (PARTITION BY {key} ORDER BY ordinal)),
cuts AS (SELECT *, coalesce(({base} - widest % {base}) % {base}, later, ordinal + {hard - 1}) AS cut, widest IS NULL AND later IS NULL AS forced FROM near),
steps AS (SELECT *, 0 AS batch_no FROM cuts WHERE place = 0
  UNION ALL SELECT c.*, s.batch_no + 1 FROM steps s JOIN cuts c USING ({key}) WHERE s.n - s.place > {hard} AND c.place = s.place + s.cut - s.ordinal + 1),
walk AS (SELECT {key}, batch_no, ordinal AS first, CASE WHEN n - place <= {hard} THEN top ELSE cut END AS last, forced AND n - place > {hard} AS forced_end FROM steps)"""


def missing_word_batches(target: int, ranges: str, words: str = "words") -> str:
    """Steps up to ``missing`` (track_id, batch_no, first, last, forced_end): the batches of every run of words that no range covers."""
    left = f"""bare AS (SELECT *, ordinal - row_number() OVER (PARTITION BY track_id ORDER BY ordinal) AS run FROM {words} w
  WHERE NOT EXISTS (SELECT 1 FROM {ranges} r WHERE r.track_id = w.track_id AND w.ordinal BETWEEN r.first AND r.last))"""
    return f"""{left}, {word_batches(target, "bare", "track_id, run")},
missing AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY first) - 1 AS INT) AS batch_no, first, last, forced_end FROM walk)"""
