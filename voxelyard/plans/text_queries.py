"""Names, phrases, list cells and model answers over the driver's tables. The SQL parses on its own; texts
are made from a table's names so that each rule meets some row."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelyard.functions import text as T
from voxelyard.operators import iterative as I

from .scene_queries import query, read


def _cases(key: str, cases: list[str]) -> str:
    """SQL, also Spark's, for one of some expressions by a key's remainder."""
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


_N = "replace(p_name, ' ', '_')"
_STEM = _cases("p_partkey", [
    f"concat('CTX__', {_N}, '__', p_size, '__area12')", f"concat('INT__', {_N}, '__', p_size, '__area12')",
    f"concat('instance_0007__INT__', {_N}, '__', p_size, '__area3')", f"concat('Instance_12__CTX__', p_name, '__drawer__', p_size * 1000, '__area3')",
    f"concat('ctx__', {_N}, '__AREA9')", f"concat('INT_', {_N}, '_', p_size, '_area5')", f"concat('CTX', {_N}, '__', p_size)",
    f"concat(' CTX__', p_name, '__handle__id7__', 'Area77 ')", "'CTX__area1'", "'INT____000'", "'doors'",
])
_SYNONYMS = "CASE n WHEN 'drawers' THEN 'drawer' WHEN 'handles' THEN 'handle' WHEN 'doors' THEN 'door' WHEN 'cabinets' THEN 'cabinet' ELSE n END"


@query(f"""WITH a AS (SELECT p_partkey, regexp_replace(trim({_STEM}), '^instance_[0-9]+__', '', 'i') AS s FROM part),
b AS (SELECT *, CASE WHEN s LIKE 'CTX%' THEN 'CTX' WHEN s LIKE 'INT%' THEN 'INT' END AS tag, list_filter(string_split(s, CASE WHEN contains(s, '__') THEN '__' ELSE '_' END), lambda x: x <> '') AS p FROM a),
c AS (SELECT *, CASE WHEN tag IS NULL OR len(p) = 0 THEN p WHEN p[1] = tag THEN p[2:] WHEN starts_with(p[1], tag) THEN list_prepend(substr(p[1], 4), p[2:]) ELSE p END AS r FROM b),
d AS (SELECT *, coalesce(list_min(list_filter(list_transform(r, lambda x, i: CASE WHEN regexp_full_match(x, '[0-9]+|(?i:area)[0-9]+') THEN i END), lambda x: x IS NOT NULL)), len(r) + 1) AS e FROM c),
f AS (SELECT *, trim(regexp_replace(lower(coalesce(array_to_string(r[1:e - 1], ' '), '')), '[ \\t]+', ' ', 'g')) AS n FROM d)
SELECT p_partkey, CASE tag WHEN 'INT' THEN 'affordance' ELSE 'object' END AS type, CASE WHEN n = '' THEN 'unknown' ELSE {_SYNONYMS} END AS name,
CASE WHEN regexp_full_match(r[e], '[0-9]+') THEN CASE WHEN length(r[e]) >= 3 THEN r[e] ELSE lpad(r[e], 3, '0') END ELSE '000' END AS inst FROM f""")
def mask_name_parse(spark, d):
    return read(spark, d, "part").select("p_partkey", T.mask_parts(F.expr(_STEM)).alias("m")).select("p_partkey", "m.type", "m.name", "m.inst")


_SAID = _cases("p_partkey", [*[f"concat('{a}', p_name, ', other')" for a in T.ACTIONS], "concat('Rotate ', upper(p_name))", "concat('hook_turn ', p_name)", "concat('open ', p_name)", "concat('push  Drawer   front ', p_size)", "'press socket opening,x'", "'N/A'", "concat('pull  pull ', p_name)", "concat('Drawer HANDLE ', p_size)"])
_FOLD = "trim(regexp_replace({}, '[ \\t]+', ' ', 'g'))"
_ACTS = "^(" + "|".join(T.ACTIONS) + ")"


@query(f"""WITH s AS (SELECT p_partkey, {_SAID} AS said FROM part),
n AS (SELECT *, CASE WHEN lower(said) = 'n/a' THEN '' ELSE {_FOLD.format('said')} END AS n FROM s),
o AS (SELECT *, {_FOLD.format(f"regexp_replace(trim(split_part(n, ',', 1)), '{_ACTS}', '', 'i')")} AS o, {_FOLD.format(f"regexp_replace(n, '{_ACTS}', '', 'i')")} AS w FROM n)
SELECT p_partkey, w AS without, CASE WHEN lower(o) = 'socket opening' THEN 'socket' WHEN contains(lower(o), 'drawer') AND NOT contains(lower(o), 'handle') THEN 'drawer handle' ELSE o END AS object FROM o""")
def action_strip(spark, d):
    said = F.expr(_SAID)
    return read(spark, d, "part").select("p_partkey", T.strip_action(said).alias("without"), T.interactive_object(said).alias("object"))


#: A name map with cycles and walks into them, as a scene's map file may have it.
NAMES = {"STANDARD": "SMALL", "SMALL": "MEDIUM", "MEDIUM": "STANDARD", "LARGE": "STANDARD", "ECONOMY": "PROMO", "PROMO": "ECONOMY", "A": "B", "B": "C"}


@query(f"""WITH RECURSIVE w AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS name FROM part UNION ALL SELECT -1, 'A'),
m(k, v) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in NAMES.items())}),
r AS (SELECT k, v AS cur, []::VARCHAR[] AS seen FROM m UNION ALL SELECT r.k, m.v, list_append(r.seen, r.cur) FROM r JOIN m ON m.k = r.cur WHERE NOT list_contains(r.seen, r.cur)),
c AS (SELECT k, arg_max(cur, len(seen)) AS canon FROM r GROUP BY 1)
SELECT p_partkey, name, coalesce(canon, name) AS canon FROM w LEFT JOIN c ON k = name""")
def name_map_closure(spark, d):
    closed = F.create_map(*[F.lit(x) for pair in I.closed_map(NAMES).items() for x in pair])
    words = read(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("name")).unionByName(spark.sql("SELECT -1L AS p_partkey, 'A' AS name"))
    return words.withColumn("canon", F.coalesce(closed[F.col("name")], F.col("name")))


_PHRASE = _cases("p_partkey", ["p_name", "concat('  Door_Handle', '')", "'rotate   door handle'", "'Door Handle'", "concat('the Socket-Opening ', p_size)", "concat(p_name, ' (', p_size, ') /x')", "'__'", "concat('A', repeat('b c', 40))"])


@query(f"""WITH s AS (SELECT p_partkey, {_PHRASE} AS t FROM part),
n AS (SELECT *, trim(regexp_replace(replace(lower(t), '_', ' '), '[ ]+', ' ', 'g')) AS bare, trim(regexp_replace(lower(t), '[ ]+', ' ', 'g')) AS n FROM s),
m AS (SELECT *, {_SYNONYMS} AS name, trim(regexp_replace(regexp_replace(n, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM n),
q AS (SELECT *, CASE WHEN slug = '' THEN 'prompt' ELSE slug END AS slug1, trim(regexp_replace(regexp_replace(name, '[^a-z0-9_.-]+', '_', 'g'), '_+', '_', 'g'), '_') AS safe,
 trim(regexp_replace(regexp_replace(replace(lower(trim(t)), ' ', '_'), '[^a-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '_') AS cls, list_filter(regexp_split_to_array(n, '[ _-]+'), lambda x: x <> '') AS words FROM m)
SELECT p_partkey, CASE WHEN bare IN ('door handle', 'rotate door handle') THEN 'door_handle_group' ELSE bare END AS handle_group, lower(trim(t)) = 'door handle' AS is_handle,
CASE WHEN n = 'door handle' THEN 'rotate door handle' ELSE trim(regexp_replace(t, '[ ]+', ' ', 'g')) END AS video, CASE WHEN safe = '' THEN 'unknown' ELSE safe END AS safe, CASE WHEN cls = '' THEN 'unknown' ELSE cls END AS cls,
CASE WHEN length(slug1) > 80 THEN rtrim(substr(slug1, 1, 80), '_') ELSE slug1 END AS slug, CASE WHEN list_contains(words, 'socket') AND list_contains(words, 'opening') THEN 'socket' ELSE n END AS clean FROM q""")
def phrase_names(spark, d):
    t = F.expr(_PHRASE)
    return read(spark, d, "part").select("p_partkey", T.handle_group(t).alias("handle_group"), T.is_door_handle(t).alias("is_handle"), T.video_prompt(t, F.lit("INT")).alias("video"), T.safe_name(t).alias("safe"), T.class_name(t).alias("cls"), T.slug(t).alias("slug"), T.clean_phrase(t).alias("clean"))


_CELL = _cases("p_partkey", ["concat('[\"', p_name, '\", \"x_y\"]')", "concat('[''', p_name, ''', ''B-c'']')", "concat(p_name, ', b , ,c')", "concat(p_name, '; b;b')", "concat('a|', p_name)", "p_name", "''", "'N/A'", "concat('[', p_name, ', ]b')", "'none'"])


@query(f"""WITH s AS (SELECT p_partkey, {_CELL} AS c FROM part),
l AS (SELECT *, CASE p_partkey % 10 WHEN 0 THEN json_extract_string(c, '$[*]') WHEN 1 THEN json_extract_string(replace(c, '''', '"'), '$[*]') END AS lit FROM s),
x AS (SELECT *, list_filter(list_transform(CASE WHEN c = 'N/A' THEN [] WHEN lit IS NOT NULL THEN lit WHEN contains(c, ',') THEN string_split(c, ',') WHEN contains(c, ';') THEN string_split(c, ';') ELSE string_split(c, '|') END, lambda v: trim(v)), lambda v: v <> '') AS parts,
  list_filter(list_transform(coalesce(lit, [c]), lambda v: trim(v)), lambda v: v <> '') AS single FROM l)
SELECT p_partkey, array_to_string(parts, '#') AS parts, array_to_string(list_transform(parts, lambda v: trim(regexp_replace(translate(lower(v), '_-', '  '), '[ ]+', ' ', 'g'))), '#') AS objects, array_to_string(single, '#') AS single FROM x""")
def list_cells(spark, d):
    c = F.expr(_CELL)
    return read(spark, d, "part").select("p_partkey", *[F.array_join(f(c), "#").alias(n) for n, f in (("parts", T.list_cell), ("objects", T.object_cell), ("single", T.single_or_list))])


_PROMPTS = _cases("p_partkey", ["concat(p_name, ';', upper(p_name), '; Knob ;knob')", "concat('a ;A;  b', p_size, ' ;')", "''"])


@query(f"""WITH s AS (SELECT p_partkey, list_filter(list_transform(string_split({_PROMPTS}, ';'), lambda x: trim(regexp_replace(x, '[ ]+', ' ', 'g'))), lambda x: x <> '') AS p FROM part)
SELECT p_partkey, array_to_string(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i), '#') AS prompts FROM s""")
def prompt_lists(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(T.split_prompts(F.expr(_PROMPTS)), "#").alias("prompts"))


_ANSWER = _cases("event_id", ["concat('Sure: ', props, ' and }')", "concat('{\"a\": ', props, ', \"id\": \" ', user_id, ' \", \"score\": ', value / 50, '} {}')", "'no object'", "concat('{{', props)", "concat('} {\"id\": \"x', user_id, '\", \"score\": -1}')"])


@query(f"""WITH RECURSIVE s AS (SELECT event_id, {_ANSWER} AS t FROM events), p AS (SELECT event_id, t, strpos(t, '{{') AS a FROM s),
w AS (SELECT event_id, t, a, a AS pos, 1 AS depth FROM p WHERE a > 0 UNION ALL SELECT event_id, t, a, pos + 1, depth + CASE substr(t, (pos + 1)::INT, 1) WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END FROM w WHERE depth > 0 AND pos < length(t)),
e AS (SELECT event_id, max(CASE WHEN depth = 0 THEN substr(t, a::INT, (pos - a + 1)::INT) END) AS obj FROM w GROUP BY 1),
f AS (SELECT event_id, obj, CASE event_id % 5 WHEN 1 THEN json_extract_string(obj, '$.id') WHEN 4 THEN json_extract_string(obj, '$.id') END AS id, CASE WHEN event_id % 5 IN (1, 4) THEN json_extract_string(obj, '$.score')::DOUBLE END AS score FROM p LEFT JOIN e USING (event_id))
SELECT event_id, obj, CASE WHEN regexp_full_match(trim(id), '[0-9]+') THEN trim(id)::BIGINT END AS id, CASE WHEN score IS NOT NULL THEN round(least(greatest(score, 0), 1), 6) END AS score FROM f""")
def model_answers(spark, d):
    answer = F.expr(_ANSWER.replace("value / 50", "share"))
    events = read(spark, d, "events").withColumn("share", T.number_text(F.col("value") / 50))
    said = events.select("event_id", T.first_object(answer).alias("obj"))
    parts = F.when(F.col("event_id") % 5 != 3, F.col("obj"))
    return said.select("event_id", "obj", T.whole_id(F.get_json_object(parts, "$.id")).alias("id"), F.round(T.clamp01(F.get_json_object(parts, "$.score")), 6).alias("score"))


@query("""WITH s AS (SELECT user_id, min(event_id) % 300 AS a, max(event_id) % 300 AS b, count(*) % 50 AS c FROM events GROUP BY 1),
f AS (SELECT user_id, unnest(list_distinct(list_concat(range(least(a, b)::BIGINT, greatest(a, b)::BIGINT + 1), [c::BIGINT, c::BIGINT]))) AS frame FROM s)
SELECT user_id, frame::INT AS frame, '/out/v.1/x_f' || lpad(frame::VARCHAR, 4, '0') || '.png' AS path FROM f""")
def frame_specs(spark, d):
    s = read(spark, d, "events").groupBy("user_id").agg((F.min("event_id") % 300).alias("a"), (F.max("event_id") % 300).alias("b"), (F.count(F.lit(1)) % 50).alias("c"))
    specs = F.array(F.concat_ws("-", "a", "b"), F.col("c").cast("string"), F.lit(" "), F.concat(F.lit(" "), F.col("c").cast("string")))
    return s.select("user_id", F.explode(T.frame_numbers(specs)).alias("frame")).withColumn("path", T.frame_path(F.lit("/out/v.1/x.png"), F.col("frame")))
