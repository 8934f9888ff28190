"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code: fixtures by window functions and
``string_agg``, tags by ``regexp_extract_all``, JSON checks by ``json_valid`` /
``json_keys``.  Helpers below only build SQL text.
"""

from __future__ import annotations

from tessera.functions.text import PY_WHITESPACE, WS_CLASS
from tessera.functions.tokens import APPROX_TOKEN_PATTERN
from tessera.operators.cad import NUMBER_PATTERN, STRING_PATTERN
from tessera.operators.requests import (BATCH_RULES, REVIEW_TEMPLATE, STAGE1_INSTRUCTION,
                                        SYSTEM_MESSAGE, TRAIN_INSTRUCTION)
from tessera.functions.chat import CHATML


def lit(s: str) -> str:
    """A SQL string literal; newlines become ``chr(10)`` pieces."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")"


WS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def tag_or_null(x: str, tag: str) -> str:
    return f"regexp_extract_all({x}, '(?s)<{tag}>(.*?)</{tag}>', 1)[1]"


def first_tag(x: str, tag: str) -> str:
    return f"coalesce({strip(tag_or_null(x, tag))}, '')"


def numbered(x: str, tag: str, i: str) -> str:
    """Stripped ``<tag_i>`` content or ''."""
    pat = f"'(?s)<{tag}_' || {i} || '>(.*?)</{tag}_' || {i} || '>'"
    return f"coalesce({strip(f'regexp_extract_all({x}, {pat}, 1)[1]')}, '')"


def json_block(c: str) -> str:
    j = strip(tag_or_null(c, "json"))
    return f"(CASE WHEN json_valid({j}) AND starts_with({j}, '{{') THEN {j} END)"


def part_count(doc: str) -> str:
    return (f"(CASE WHEN {doc} IS NULL THEN 0 ELSE coalesce(len(list_filter(json_keys({doc}, '$.parts'), "
            f"lambda k: regexp_matches(k, '^part_[0-9]+'))), 0) END)::BIGINT")


def tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{APPROX_TOKEN_PATTERN}'))::BIGINT"


def pct(n: str, tot: str) -> str:
    return f"CAST((2000 * {n} + {tot}) // (2 * {tot}) AS DOUBLE) / 10"


OPS = ("CASE l_linenumber % 4 WHEN 1 THEN 'NewBodyFeatureOperation' WHEN 2 THEN 'JoinFeatureOperation' "
       "WHEN 3 THEN 'CutFeatureOperation' ELSE 'IntersectFeatureOperation' END")

CTE = {
    "tagged": ("""SELECT doc_id, CASE doc_id % 5
        WHEN 0 THEN '<description>' || chr(10) || text || chr(10) || '</description>'
        WHEN 1 THEN '<valid> Yes </valid><description>' || text || '</description><think> ' || lang
                    || ' </think><json>{"n":' || n_chars || '}</json>'
        WHEN 2 THEN '<valid>No</valid><think></think><json>{"n":' || n_chars || ' x</json>'
        WHEN 3 THEN '<think>a</think><think>b</think>'
        ELSE text END AS answer FROM documents""", []),
    "stage1": ("""SELECT d.doc_id, t.answer AS prompt, CASE d.doc_id % 4
        WHEN 0 THEN '{"final_shape":"s","parts":{"part_1":{"extrusion":{"extrude_depth_towards_normal":'
                    || (d.n_chars % 7) || '.5,"operation":"NewBodyFeatureOperation"},"description":{"shape":"x"}}}}'
        WHEN 1 THEN '{"parts":'
        WHEN 2 THEN '[' || d.doc_id || ']'
        ELSE '{"parts":{"part_1":{"extrusion":{"operation":"JoinFeatureOperation"}},"part_2":{"extrusion":{"sketch_scale":0.25,"operation":"CutFeatureOperation"}}}}'
        END AS completion FROM documents d JOIN tagged t USING (doc_id)""", ["tagged"]),
    "reasoned": (f"""SELECT doc_id,
        coalesce('<description>' || {strip(tag_or_null('answer', 'description'))} || '</description>', answer) AS description,
        '<think>' || coalesce({tag_or_null('answer', 'think')}, '') || '</think>' AS reasoning,
        '<json>' || chr(10) || {first_tag('answer', 'json')} || chr(10) || '</json>' AS completion,
        CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'en_vi' END AS split FROM tagged""", ["tagged"]),
    "parts": (f"""SELECT l_orderkey AS id, CAST(l_quantity AS BIGINT) AS q, {OPS} AS op,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
                           l_extendedprice, l_quantity) AS k FROM lineitem""", []),
    "parts_s": ("""SELECT *, '"part_' || k || '":{"extrusion":{"extrude_depth_towards_normal":' || q
        || ',"operation":"' || op || '"},"description":{"shape":""}}' AS s FROM parts""", ["parts"]),
    "cad": ("""SELECT id, '<json>' || chr(10) || '{"final_shape":"","parts":{' || string_agg(s, ',' ORDER BY k)
        || '}}' || chr(10) || '</json>' AS completion, count(*)::BIGINT AS n FROM parts_s GROUP BY id""", ["parts_s"]),
    "cad_damaged": ("""SELECT id, CASE WHEN id % 11 = 0 THEN substr(completion, 1, length(completion) - 20) || '</json>'
        WHEN id % 13 = 0 THEN substr(completion, 8, length(completion) - 15)
        WHEN id % 17 = 0 THEN replace(completion, '</json>', 'x</json>') ELSE completion END AS completion
        FROM cad""", ["cad"]),
    "batched": ("""SELECT *, ord // 4 AS batch_id, CAST(ord % 4 + 1 AS INTEGER) AS pos
        FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS ord FROM cad)""", ["cad"]),
    "pairs": ("""SELECT p.conv_id, p.turn, s.system, p.prompt, p.completion FROM (
          SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS completion
          FROM conversations u LEFT JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
          WHERE u.role = 'user'
          UNION ALL
          SELECT conv_id, turn, NULL, text FROM conversations x WHERE role = 'assistant' AND NOT EXISTS (
            SELECT 1 FROM conversations y WHERE y.conv_id = x.conv_id AND y.role = 'user' AND y.turn + 1 = x.turn)
          UNION ALL
          SELECT DISTINCT conv_id, NULL::INTEGER, NULL, NULL FROM conversations x WHERE NOT EXISTS (
            SELECT 1 FROM conversations y WHERE y.conv_id = x.conv_id AND y.role IN ('user', 'assistant'))) p
        LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS system FROM conversations
                   WHERE role = 'system' GROUP BY conv_id) s USING (conv_id)""", []),
    "maxp": ("SELECT max(n) AS m FROM cad", ["cad"]),
}


def _answers_ctes(src: str, prefix: str) -> dict:
    """Stand-in model answers and the parsed verdict for batched rows in CTE
    ``src`` (columns id, n, completion, batch_id, pos)."""
    p = prefix
    return {
        f"{p}turns_in": (f"""SELECT ps.id, ps.k, b.n, b.pos, b.batch_id,
            '<json_' || ps.k || '>{{"parts":{{' || array_to_string(array_agg(ps.s) OVER (PARTITION BY ps.id ORDER BY ps.k
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ',') || '}}}}</json_' || ps.k || '>' || chr(10)
            || '<prompt_' || ps.k || '>' || CASE WHEN ps.id % 7 = 1 AND ps.k = b.n THEN ' ' ELSE 'add ' || ps.op END
            || '</prompt_' || ps.k || '>'
            || CASE WHEN ps.id % 7 = 0 AND ps.k = 1 THEN '' ELSE '<think_' || ps.k || '> depth ' || ps.q
                    || ' </think_' || ps.k || '>' END AS t
            FROM parts_s ps JOIN {src} b USING (id)""", ["parts_s", src]),
        f"{p}blocks": (f"""SELECT id, '<sample_' || any_value(pos) || '>' || chr(10) || string_agg(t, chr(10) ORDER BY k)
            || chr(10) || '</sample_' || any_value(pos) || '>' AS block FROM {p}turns_in WHERE id % 7 <> 2 GROUP BY id""",
                       [f"{p}turns_in"]),
        f"{p}responses": (f"""SELECT b.batch_id, CASE WHEN b.batch_id % 9 = 8 THEN NULL
            ELSE coalesce(string_agg(bl.block, chr(10) ORDER BY b.pos), '') END AS response
            FROM {src} b LEFT JOIN {p}blocks bl USING (id) GROUP BY b.batch_id""", [src, f"{p}blocks"]),
        f"{p}unbatched": (f"""SELECT b.*, {strip("regexp_extract_all(r.response, '(?s)<sample_' || b.pos || '>(.*?)</sample_' || b.pos || '>', 1)[1]")} AS content
            FROM {src} b LEFT JOIN {p}responses r USING (batch_id)""", [src, f"{p}responses"]),
        f"{p}turns": (f"""SELECT u.id, i.turn,
            {numbered('u.content', 'prompt', 'i.turn')} AS input,
            {numbered('u.content', 'think', 'i.turn')} AS think,
            {numbered('u.content', 'json', 'i.turn')} AS json
            FROM {p}unbatched u CROSS JOIN (SELECT range::INTEGER AS turn FROM range(1, (SELECT max(n) FROM {src}) + 1)) i
            WHERE regexp_matches(u.content, '(?s)<(prompt|think|json)_' || i.turn || '>')""",
                      [f"{p}unbatched"]),
        f"{p}verdict": (f"""SELECT u.id, u.batch_id, u.pos, coalesce(length(u.content), 0)::BIGINT AS new_length,
            {part_count(json_block('u.completion'))} AS original_parts, coalesce(g.generated, 0)::BIGINT AS generated
            FROM {p}unbatched u LEFT JOIN (SELECT id, count_if(input <> '' AND think <> '' AND json <> '') AS generated
                                           FROM {p}turns GROUP BY id) g USING (id)""", [f"{p}unbatched", f"{p}turns"]),
    }


CTE.update(_answers_ctes("batched", ""))
CTE["failed"] = ("""SELECT id FROM batched WHERE id % 7 IN (0, 1, 2) OR batch_id % 9 = 8
    UNION ALL SELECT -1 UNION ALL SELECT -2
    UNION ALL SELECT min(id) FROM batched WHERE id % 7 = 0""", ["batched"])
CTE["retry_batched"] = ("""SELECT *, ord // 4 AS batch_id, CAST(ord % 4 + 1 AS INTEGER) AS pos FROM
    (SELECT *, row_number() OVER (ORDER BY id) - 1 AS ord FROM cad WHERE id IN (SELECT id FROM failed))""",
                        ["cad", "failed"])
CTE.update(_answers_ctes("retry_batched", "r_"))


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTE[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][0]})" for n in order) + "\n" + body


def verdict_cols(p: str = "") -> str:
    return (f"SELECT id, batch_id, pos, new_length, original_parts, generated, "
            f"(generated = 0 OR generated <> original_parts) AS is_failed FROM {p}verdict")


def _stage1_prompt(text: str) -> str:
    return f"{lit(STAGE1_INSTRUCTION + chr(10) + chr(10) + '<description>' + chr(10))} || {text} || chr(10) || '</description>'"


def _render(pairs: list[tuple[str, str]], gen: bool) -> str:
    pieces = []
    for role, content in pairs:
        pieces.append(f"{lit(CHATML['start'] + role + CHATML['sep'])} || {content} || {lit(CHATML['end'])}")
    if gen:
        pieces.append(lit(CHATML["generation"]))
    return " || ".join(pieces)


def _single_request() -> str:
    before, rest = REVIEW_TEMPLATE.split("{prompt}")
    middle, after = rest.split("{completion}")
    return f"{lit(before)} || prompt || {lit(middle)} || completion || {lit(after)}"


def _batch_request() -> str:
    inputs = ("string_agg('<input_' || pos || '>' || chr(10) || completion || chr(10) || '</input_' || pos || '>', "
              "chr(10) ORDER BY pos)")
    skel = ("string_agg('<sample_' || pos || '>' || chr(10) || 'output_' || pos || chr(10) || '</sample_' || pos || '>', "
            "chr(10) ORDER BY pos)")
    return (f"'Process each of the ' || count(*) || ' inputs separately.' || chr(10) || chr(10) || 'INPUTS:' || chr(10) || {inputs}"
            f" || chr(10) || chr(10) || 'OUTPUT:' || chr(10) || {skel} || chr(10) || chr(10) || 'RULES:' || chr(10) || {lit(BATCH_RULES)} || chr(10)")


CTE["loops"] = ("""SELECT id, max(k) AS n FROM parts GROUP BY id""", ["parts"])
# the sketch documents, rebuilt as text, then parsed back with DuckDB's JSON functions
CTE["sk"] = ("""SELECT id, '{"parts":{"part_1":{"sketch":{"face_1":{"loop_1":{' || string_agg(line, ',' ORDER BY k DESC) || '}'
        || CASE WHEN id % 5 = 0 THEN ',"loop_2":{"circle_1":{"Center":[0.5,0.5],"Radius":0.25}}' ELSE '' END
        || '}}}}}' AS doc
        FROM (SELECT p.id, p.k, '"line_' || p.k || '":{"Start Point":[' || p.k || ',' || p.q || '],"End Point":'
                     || CASE WHEN p.k < m.n THEN '[' || (p.k + 1) || ',' || nx.q || ']'
                             WHEN p.id % 3 = 0 THEN '[1,' || (f.q + 1) || ']' ELSE '[1,' || f.q || ']' END || '}' AS line
              FROM parts p JOIN loops m USING (id) JOIN parts f ON f.id = p.id AND f.k = 1
              LEFT JOIN parts nx ON nx.id = p.id AND nx.k = p.k + 1)
        GROUP BY id""", ["parts", "loops"])
CTE["sk_lp"] = ("SELECT id, doc, unnest(json_keys(doc, '$.parts.part_1.sketch.face_1')) AS loop FROM sk", ["sk"])
CTE["sk_pk"] = ("SELECT id, doc, loop, unnest(json_keys(doc, '$.parts.part_1.sketch.face_1.' || loop)) AS prim FROM sk_lp",
                ["sk_lp"])
CTE["sk_prims"] = ("""SELECT id, loop, prim, TRY_CAST(regexp_extract(prim, '([0-9]+)$', 1) AS BIGINT) AS num,
        json_extract(doc, '$.parts.part_1.sketch.face_1.' || loop || '.' || prim || '."Start Point"')::DOUBLE[] AS sp,
        json_extract(doc, '$.parts.part_1.sketch.face_1.' || loop || '.' || prim || '."End Point"')::DOUBLE[] AS ep
        FROM sk_pk""", ["sk_pk"])
CTE["sk_segs"] = ("""SELECT *, row_number() OVER (PARTITION BY id, loop ORDER BY num) AS i,
        count(*) OVER (PARTITION BY id, loop) AS ns FROM sk_prims WHERE NOT starts_with(prim, 'circle')""", ["sk_prims"])
CTE["sk_links"] = ("""SELECT a.id, a.loop, bool_and(coalesce(a.ep = b.sp, false)) AS ok FROM sk_segs a JOIN sk_segs b
        ON a.id = b.id AND a.loop = b.loop AND b.i = (a.i % a.ns) + 1 GROUP BY a.id, a.loop""", ["sk_segs"])


def queries() -> dict[str, str]:
    Q: dict[str, str] = {}
    a = "answer"
    Q["tag_first_trimmed"] = sql(f"""SELECT doc_id, {first_tag(a, 'think')} AS think, {first_tag(a, 'json')} AS json,
        {first_tag(a, 'valid')} AS valid, {first_tag(a, 'description')} AS description FROM tagged""", "tagged")
    Q["tag_first_or_null"] = sql(f"""SELECT doc_id, {tag_or_null(a, 'think')} AS think, {tag_or_null(a, 'json')} AS json,
        {tag_or_null(a, 'valid')} AS valid, {tag_or_null(a, 'description')} AS description FROM tagged""", "tagged")
    Q["description_block"] = sql(f"""SELECT doc_id, coalesce('<description>' || {strip(tag_or_null(a, 'description'))}
        || '</description>', answer) AS prompt FROM tagged""", "tagged")
    Q["prompt_wrap"] = sql(f"""SELECT CAST(doc_id AS VARCHAR) AS uid,
        {_stage1_prompt("array_to_string(string_split(text, chr(10)), chr(10))")} AS prompt,
        '{{"lang":"' || lang || '","n":' || n_chars || '}}' AS completion FROM documents""")
    Q["assemble_train"] = sql(f"""SELECT doc_id, CASE split WHEN 'test' THEN 'val' ELSE 'train_en_vi' END AS split,
        {lit(TRAIN_INSTRUCTION + chr(10) + chr(10))} || description AS prompt,
        reasoning || chr(10) || chr(10) || completion AS completion FROM reasoned""", "reasoned")
    Q["train_length_max"] = sql(f"""SELECT CASE split WHEN 'test' THEN 'val' ELSE 'train_en_vi' END AS split,
        max({tokens(lit(TRAIN_INSTRUCTION + chr(10) + chr(10)) + " || description || reasoning || chr(10) || chr(10) || completion")}) AS max_tokens
        FROM reasoned GROUP BY 1""", "reasoned")
    Q["json_strict_filter"] = sql(f"""SELECT id, doc FROM (SELECT id, {json_block('completion')} AS doc FROM cad_damaged)
        WHERE doc IS NOT NULL""", "cad_damaged")
    Q["json_clean"] = sql("""SELECT id, '<json>' || chr(10) || '{"parts":{' || string_agg('"part_' || k
        || '":{"extrusion":{"extrude_depth_towards_normal":' || q || '.0,"operation":"' || op || '"}}', ',' ORDER BY k)
        || '}}' || chr(10) || '</json>' AS cleaned FROM parts GROUP BY id""", "parts")
    Q["json_clean_exact"] = sql("""SELECT id, '<json>' || chr(10) || '{"parts":{' || string_agg('"part_' || k
        || '":{"extrusion":{"extrude_depth_towards_normal":' || q || ',"operation":"' || op || '"}}', ',' ORDER BY k)
        || '}}' || chr(10) || '</json>' AS cleaned FROM parts GROUP BY id""", "parts")
    Q["part_count"] = sql(f"SELECT id, {part_count(json_block('completion'))} AS part_count FROM cad_damaged",
                          "cad_damaged")
    pc = f"(SELECT id, {part_count(json_block('completion'))} AS pc FROM cad_damaged)"
    survey_row = f"""SELECT count(*)::BIGINT AS total, count_if(pc > 0)::BIGINT AS valid,
        coalesce(max(CASE WHEN pc > 0 THEN pc END), 0)::BIGINT AS max_parts,
        count(DISTINCT CASE WHEN pc > 0 THEN pc END)::BIGINT AS n_distinct,
        count_if(pc > 0 AND pc = 3)::BIGINT AS consistent_rows,
        (count_if(pc > 0 AND pc = 3) = count_if(pc > 0) AND count(DISTINCT CASE WHEN pc > 0 THEN pc END) = 1
         AND count_if(pc > 0 AND pc = 3) > 0) AS is_consistent FROM {pc}"""
    Q["part_survey"] = sql(survey_row, "cad_damaged")
    Q["part_histogram"] = sql(f"""SELECT pc AS part_count, n, {pct('n', 'tot')} AS pct FROM (
        SELECT pc, count(*)::BIGINT AS n, sum(count(*)) OVER ()::BIGINT AS tot FROM {pc} WHERE pc > 0 GROUP BY pc)""",
                              "cad_damaged")
    Q["deinterleave_lang"] = sql(f"""SELECT CASE WHEN ord % 2 = 0 THEN 'en' ELSE 'vi' END AS lang,
        count(*)::BIGINT AS n_rows, count_if(doc IS NOT NULL)::BIGINT AS n_kept, count_if(doc IS NULL)::BIGINT AS n_removed
        FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS ord, {json_block('completion')} AS doc FROM cad_damaged)
        GROUP BY 1""", "cad_damaged")
    Q["interleave"] = sql("""SELECT ord, doc_id, lang FROM (
        SELECT o * 4 + s AS ord, doc_id, lang, o, s FROM (
          SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS o,
                 CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END AS s FROM documents))
        WHERE s IS NOT NULL AND o < (SELECT least(count_if(lang = 'en'), count_if(lang = 'fr'), count_if(lang = 'de'),
                                                  count_if(lang = 'es')) FROM documents)""")
    Q["index_slice"] = sql("""SELECT ord, o_orderkey, 'orders_1000_20000' AS split FROM (
        SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders)
        WHERE ord >= 1000 AND ord < 20000""")
    Q["worker_slices"] = sql("""WITH t AS (SELECT least((SELECT count(*) FROM orders) - 100, 12000) AS total),
        o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders)
        SELECT CAST(least((ord - 100) // ((SELECT total FROM t) // 4), 3) AS INTEGER) AS slice_id,
               count(*)::BIGINT AS n_rows, min(ord)::BIGINT AS first_ord, max(ord)::BIGINT AS last_ord
        FROM o WHERE ord >= 100 AND ord < 100 + (SELECT total FROM t) GROUP BY 1""")
    bucket = f"(({tokens('text')}) // 500) * 500"
    Q["token_buckets"] = sql(f"""SELECT 'range_' || b || '_' || (b + 500) || '_' || lang AS split, count(*)::BIGINT AS n_rows
        FROM (SELECT {bucket} AS b, lang FROM documents) GROUP BY 1""")
    Q["token_minmax"] = sql(f"""SELECT lang, min(n)::BIGINT AS min_tokens, max(n)::BIGINT AS max_tokens
        FROM (SELECT lang, {tokens('text')} AS n FROM documents) GROUP BY lang""")
    Q["split_sizes"] = Q["token_buckets"]
    desc_prompt = f"coalesce('<description>' || {strip(tag_or_null('prompt', 'description'))} || '</description>', prompt)"
    cleaned = """CASE doc_id % 4
        WHEN 0 THEN '<json>' || chr(10) || '{"parts":{"part_1":{"extrusion":{"extrude_depth_towards_normal":'
                    || (n_chars % 7) || '.5,"operation":"NewBodyFeatureOperation"}}}}' || chr(10) || '</json>'
        WHEN 3 THEN '<json>' || chr(10) || '{"parts":{"part_1":{"extrusion":{"operation":"JoinFeatureOperation"}},"part_2":{"extrusion":{"sketch_scale":0.25,"operation":"CutFeatureOperation"}}}}' || chr(10) || '</json>'
        END"""
    Q["clean_and_bucket"] = sql(f"""SELECT doc_id, lang, 'range_' || (n_tokens // 500) * 500 || '_' || ((n_tokens // 500) * 500 + 500)
        || '_' || lang AS split, n_tokens, prompt, completion FROM (
          SELECT s.doc_id, CASE WHEN (row_number() OVER (ORDER BY s.doc_id) - 1) % 2 = 0 THEN 'en' ELSE 'vi' END AS lang,
                 {desc_prompt} AS prompt, {cleaned} AS completion, {tokens(desc_prompt)} AS n_tokens
          FROM stage1 s JOIN documents d USING (doc_id))
        WHERE completion IS NOT NULL""", "stage1")
    Q["single_requests"] = sql(f"SELECT doc_id, {_single_request()} AS request FROM stage1", "stage1")
    Q["batch_requests"] = sql(f"SELECT batch_id, count(*)::BIGINT AS n_rows, {_batch_request()} AS request FROM batched GROUP BY batch_id",
                              "batched")
    user = f"{lit(TRAIN_INSTRUCTION + chr(10) + chr(10) + '<description>' + chr(10))} || text || chr(10) || '</description>'"
    Q["inference_requests"] = sql(f"SELECT doc_id, {_render([('system', lit(SYSTEM_MESSAGE)), ('user', user)], True)} AS rendered FROM documents")
    one = lambda role, x: f"coalesce({_render([(role, x)], False)}, '')"
    Q["chat_messages"] = sql(f"""SELECT conv_id, turn, completion IS NOT NULL AS answered,
        {one('system', 'system')} || {one('user', 'prompt')} || {one('assistant', 'completion')} AS text FROM pairs""", "pairs")
    Q["unbatch"] = sql("SELECT id, batch_id, pos, coalesce(length(content), 0)::BIGINT AS new_length FROM unbatched", "unbatched")
    Q["turns_long"] = sql("""SELECT id, turn, input, think, json, (input <> '' AND think <> '' AND json <> '') AS complete
        FROM turns""", "turns")
    Q["turns_wide"] = sql("""SELECT u.id, u.completion AS original_completion, coalesce(length(u.content), 0)::BIGINT AS new_length,
        m.m AS width, to_json(list_transform(range(0, 3 * m.m), lambda i: coalesce(
            list_extract(w.fields, 1 + list_position(w.places, i)::INTEGER - 1), '')))::VARCHAR AS turns
        FROM unbatched u CROSS JOIN maxp m LEFT JOIN (
          SELECT id, list(f ORDER BY p) AS fields, list(p ORDER BY p) AS places FROM (
            SELECT id, 3 * (turn - 1) AS p, input AS f FROM turns UNION ALL SELECT id, 3 * (turn - 1) + 1, think FROM turns
            UNION ALL SELECT id, 3 * (turn - 1) + 2, json FROM turns) GROUP BY id) w USING (id)""", "unbatched", "turns", "maxp")
    Q["verdict"] = sql(verdict_cols(), "verdict")
    Q["failed_log"] = sql("SELECT CAST(id AS VARCHAR) AS id FROM verdict WHERE generated = 0 OR generated <> original_parts",
                          "verdict")
    Q["failed_rows"] = sql("SELECT id, n FROM cad WHERE id IN (SELECT id FROM failed)", "cad", "failed")
    Q["missing_ids"] = sql("SELECT id FROM failed WHERE id NOT IN (SELECT id FROM cad)", "cad", "failed")
    Q["retry_parts"] = sql(f"""SELECT pc AS part_count, count(*)::BIGINT AS n, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct
        FROM (SELECT id, {json_block('completion')} AS doc, {part_count(json_block('completion'))} AS pc FROM cad_damaged)
        WHERE id IN (SELECT id FROM failed) AND len(json_keys(doc)) > 0 GROUP BY pc""", "cad_damaged", "failed")
    Q["retry_summary"] = sql("""SELECT (SELECT count(*) FROM failed)::BIGINT AS requested,
        (SELECT count(*) FROM retry_batched)::BIGINT AS found,
        (SELECT count(*) FROM failed WHERE id NOT IN (SELECT id FROM cad))::BIGINT AS not_found,
        count_if(NOT is_failed)::BIGINT AS succeeded, count_if(is_failed)::BIGINT AS failed,
        CASE WHEN (SELECT count(*) FROM failed) > 0 THEN ((2000 * ((SELECT count(*) FROM failed) - count_if(is_failed))
             + (SELECT count(*) FROM failed)) // (2 * (SELECT count(*) FROM failed)))::DOUBLE / 10 ELSE 0.0 END AS success_rate_ref
        FROM (SELECT (generated = 0 OR generated <> original_parts) AS is_failed FROM r_verdict)""",
                            "failed", "retry_batched", "r_verdict", "cad")
    Q["multi_turn_job"] = sql("""SELECT id, 'cad_0_' || (SELECT count(*) FROM cad) AS split, new_length, generated,
        (generated = 0 OR generated <> original_parts) AS is_failed FROM verdict""", "verdict", "cad")
    Q["retry_job"] = sql("""SELECT id, new_length, generated, (generated = 0 OR generated <> original_parts) AS is_failed
        FROM r_verdict""", "r_verdict")
    valid_ok = f"coalesce({strip(tag_or_null(a, 'valid'))} = 'Yes' AND length({tag_or_null(a, 'description')}) > 0 AND length({tag_or_null(a, 'think')}) > 0, false)"
    acc = f"""SELECT doc_id, {valid_ok} AS accepted,
        CASE WHEN {valid_ok} THEN '<description>' || {tag_or_null(a, 'description')} || '</description>' END AS description,
        CASE WHEN {valid_ok} THEN '<think>' || {tag_or_null(a, 'think')} || '</think>' END AS reasoning"""
    Q["accept_reject"] = sql(acc + " FROM tagged", "tagged")
    Q["reasoning_job"] = sql(f"""SELECT ord, doc_id, accepted, 'range_0_500_en_100_100000' AS split FROM (
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, {valid_ok} AS accepted FROM tagged)
        WHERE ord >= 100 AND ord < 100000""", "tagged")
    r = "t.answer"
    pred = f"""SELECT CAST(d.doc_id AS VARCHAR) AS uid, d.text AS input, {first_tag(r, 'think')} AS reasoning,
        {first_tag(r, 'json')} AS predicted_output, d.lang AS ground_truth_output"""
    Q["predictions"] = sql(pred + " FROM documents d LEFT JOIN tagged t USING (doc_id)", "tagged")
    Q["predictions_range"] = sql(f"""SELECT uid, input, reasoning, predicted_output, ground_truth_output, 'test_50_' || (SELECT count(*) FROM documents) AS split FROM (
        {pred}, row_number() OVER (ORDER BY d.doc_id) - 1 AS ord FROM documents d LEFT JOIN tagged t USING (doc_id))
        WHERE ord >= 50""", "tagged")
    Q["token_counter_udf"] = sql(f"SELECT doc_id, len(regexp_extract_all(text, '[^{WS_CLASS[1:-1]}]+'))::BIGINT AS n_tokens FROM documents")
    Q["progressive_docs"] = sql("""SELECT id, CAST(k AS INTEGER) AS k, '{"parts":{' || array_to_string(array_agg(s) OVER (
        PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ',') || '}}' AS doc FROM parts_s""",
                                "parts_s")
    is_failed = "(generated = 0 OR generated <> original_parts)"
    Q["publish_multi_turn"] = sql(f"""SELECT id, 'cad_0_' || (SELECT count(*) FROM cad) AS split, new_length, {is_failed} AS logged,
        CASE WHEN {is_failed} THEN row_number() OVER (PARTITION BY {is_failed} ORDER BY CAST(id AS VARCHAR)) - 1 END AS list_pos
        FROM verdict""", "verdict", "cad")
    Q["publish_retry"] = sql(f"""SELECT id, 'retry_tables_cad_orders_0_' || (SELECT count(*) FROM verdict WHERE {is_failed}) || 'samples' AS split,
        {is_failed} AS failed_again, (SELECT count(*) FROM r_verdict WHERE {is_failed})::BIGINT AS n_failed_again FROM r_verdict""",
                             "verdict", "r_verdict")
    Q["default_ids"] = sql(f"""SELECT 'unknown_' || b.ord AS id, r.id AS order_id, (r.generated = 0 OR r.generated <> r.original_parts) AS is_failed
        FROM r_verdict r JOIN batched b ON b.id = r.id""", "r_verdict", "batched")
    Q["path_names"] = """SELECT doc_id, source || '.en' AS name, source || '.en.json' AS file,
        'failed_ids_tables_cad_orders_0_' || strftime(make_timestamp(doc_id * 3601 * 1000000), '%Y%m%d_%H%M%S') AS log FROM documents"""
    Q["consistent_split"] = sql("""SELECT 'cad_0_' || count(*) || '_3parts' AS split, count(*)::BIGINT AS n_rows
        FROM cad WHERE n = 3""", "cad")
    Q["publish_buckets"] = "SELECT split, count(*)::BIGINT AS n_rows FROM (" + Q["clean_and_bucket"] + ") GROUP BY split"
    Q["model_calls"] = sql("""SELECT id, pos, (CASE WHEN pos = 1 THEN 1 ELSE 0 END)::BIGINT AS generated, NOT (pos = 1 AND n = 1) AS is_failed
        FROM batched""", "batched")
    Q["reasoning_counts"] = sql(f"""SELECT count_if({valid_ok})::BIGINT AS n_accepted, count_if(NOT {valid_ok})::BIGINT AS n_rejected
        FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM tagged) WHERE ord >= 10""", "tagged")
    Q["publish_reasoning"] = sql(f"""SELECT 'stage1_10_' || (SELECT count(*) FROM tagged) AS split, count_if(ok)::BIGINT AS n_rows,
        count_if(NOT ok)::BIGINT AS n_invalid, sum(CASE WHEN NOT ok THEN ord END)::BIGINT AS sum_invalid
        FROM (SELECT {valid_ok} AS ok, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM tagged) WHERE ord >= 10""", "tagged")
    Q["publish_predictions"] = ("SELECT uid, split, reasoning, predicted_output, ground_truth_output FROM ("
                                + Q["predictions_range"] + ")")
    Q["progressive_check"] = sql("""SELECT t.id, t.turn, coalesce(t.json = '{"parts":{' || array_to_string(array_agg(ps.s ORDER BY ps.k), ',') || '}}', false) AS matches
        FROM turns t JOIN parts_s ps ON ps.id = t.id AND ps.k <= t.turn JOIN cad c ON c.id = t.id
        WHERE t.turn <= c.n GROUP BY t.id, t.turn, t.json""", "turns", "parts_s", "cad")
    Q["loop_closure"] = sql("""SELECT p.id, 'part_1' AS part, 'face_1' AS face, p.loop, count(*)::BIGINT AS n_prims,
               coalesce(any_value(l.ok), true) AS closed
        FROM sk_prims p LEFT JOIN sk_links l USING (id, loop) GROUP BY p.id, p.loop""", "sk_prims", "sk_links")
    ops = "regexp_extract_all(completion, '\"operation\":\"([A-Za-z]+)\"', 1)"
    Q["operation_check"] = sql(f"""SELECT id, n AS n_parts,
        len(list_filter({ops}, lambda o: o IN ('NewBodyFeatureOperation', 'JoinFeatureOperation', 'CutFeatureOperation', 'IntersectFeatureOperation')))::BIGINT AS n_valid_ops,
        len(list_filter({ops}, lambda o: o IN ('NewBodyFeatureOperation', 'JoinFeatureOperation', 'CutFeatureOperation', 'IntersectFeatureOperation'))) = n AS all_valid
        FROM (SELECT id, n, CASE WHEN id % 19 = 0 THEN replace(completion, '"CutFeatureOperation"', '"Cut"') ELSE completion END AS completion FROM cad)""",
                               "cad")
    nums = lambda x: f"list_distinct(list_transform(regexp_extract_all({x}, '{NUMBER_PATTERN}'), lambda s: TRY_CAST(s AS DOUBLE)))"
    Q["number_coverage"] = sql(f"""SELECT doc_id, coalesce(len(jn), 0)::BIGINT AS n_json_numbers,
        coalesce(len(list_filter(jn, lambda x: list_contains(tn, x))), 0)::BIGINT AS n_covered FROM (
        SELECT doc_id, {nums(f"regexp_replace({tag_or_null(a, 'json')}, '{STRING_PATTERN}', '', 'g')")} AS jn, {nums(tag_or_null(a, 'description'))} AS tn FROM tagged)""",
                               "tagged")
    Q["drop_boilerplate"] = sql("""SELECT doc_id, length(text)::BIGINT AS n_chars_before,
        length(regexp_replace(text, '(?i)[^.\\n]*(copyright|licen[cs]e)[^.\\n]*\\.?', '', 'g'))::BIGINT AS n_chars_after
        FROM documents""")
    Q["route_by_parts"] = sql(f"""SELECT lang || '_part_' || pc AS split, count(*)::BIGINT AS n_rows FROM (
        SELECT CASE WHEN (row_number() OVER (ORDER BY id) - 1) % 2 = 0 THEN 'en' ELSE 'vi' END AS lang,
               {part_count(json_block('completion'))} AS pc FROM cad_damaged) GROUP BY 1""", "cad_damaged")
    Q["union_shards"] = sql("""SELECT doc_id, ((ord // 300) * 300)::BIGINT AS shard_start, ((ord // 300) * 300 + 300)::BIGINT AS shard_end
        FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents)""")
    Q["merge_retry"] = sql("""SELECT v.id, CASE WHEN r.id IS NOT NULL THEN 'retry' ELSE 'first' END AS source,
        CASE WHEN r.id IS NOT NULL THEN r.generated ELSE v.generated END AS generated,
        CASE WHEN r.id IS NOT NULL THEN false ELSE (v.generated = 0 OR v.generated <> v.original_parts) END AS is_failed
        FROM verdict v LEFT JOIN (SELECT DISTINCT id, generated FROM r_verdict
                                  WHERE NOT (generated = 0 OR generated <> original_parts)) r USING (id)""",
                           "verdict", "r_verdict")
    Q["unwiden"] = sql("""SELECT id, turn, input AS prompt, '<think>' || chr(10) || think || chr(10) || '</think>' || chr(10) || chr(10)
        || '<json>' || chr(10) || json || chr(10) || '</json>' AS completion FROM turns
        WHERE input <> '' AND think <> '' AND json <> ''""", "turns")
    Q["length_audit"] = sql(f"""SELECT count(*)::BIGINT AS n_rows, count_if(np + nc > 200)::BIGINT AS n_over_limit,
        max(np + nc)::BIGINT AS max_tokens, sum(np)::BIGINT AS sum_prompt_tokens, sum(nc)::BIGINT AS sum_completion_tokens
        FROM (SELECT {tokens("concat_ws(chr(10), system, prompt)")} AS np, {tokens("coalesce(completion, '')")} AS nc FROM pairs)""", "pairs")
    # values read from the texts: the last of repeated keys counts, numbers as numbers, texts unescaped
    n, key = "n_chars", "doc_id"
    pair = lambda cases: "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"
    lang = "'\"' || lang || '\"'"
    texts_a = pair([f"""'{{"k1":1,"k2":' || {lang} || ',"k1":' || {n} || '}}'""", f"""'{{"k1":NaN,"k2":' || {n} || '}}'""",
                    f"""'{{"k1":' || {n} || 'e2,"k2":' || {lang} || '}}'""", f"""'{{"k2":' || {lang} || ',"k1":' || {n} || '}}'""",
                    f"""'{{"k1":' || {n} || '.0}}'""", f"""'{{"k1":"' || {n} || '"}}'""", f"""'{{"k1":' || {n} || ',"k2":-0.0}}'""",
                    f"""'{{"k1":' || {key} || ',"k1":' || {n} || '}}'""", f"""'{{"k1":"\\u0041' || {n} || '"}}'""", f"""'{{"k1":' || {n}"""])
    texts_b = pair([f"""'{{"k1":' || {n} || ',"k2":' || {lang} || '}}'""", f"""'{{ "k2":' || {n} || ', "k1":NaN}}'""",
                    f"""'{{"k1":' || {n} || '00,"k2":' || {lang} || '}}'""", f"""'{{"k1":' || {n} || ',"k2":' || {lang} || '}}'""",
                    f"""'{{"k1":' || {n} || '}}'""", f"""'{{"k1":' || {n} || '}}'""", f"""'{{"k1":' || {n} || ',"k2":0}}'""",
                    f"""'{{"k1":' || {n} || ',"k1":' || {key} || '}}'""", f"""'{{"k1":"A' || {n} || '"}}'""", f"""'{{"k1":' || {n}"""])
    last = lambda x, k: f"regexp_extract_all({x}, '\"{k}\":([^,}}]*)', 1)[-1]"
    value = lambda x: (f"CASE WHEN {x} IS NULL THEN 'absent' WHEN starts_with({x}, '\"') THEN replace({x}, '\\u0041', 'A') "  # noqa: E731
                       f"ELSE (TRY_CAST({x} AS DOUBLE) + 0.0)::VARCHAR END")
    same = " AND ".join(f"replace({value(last('a', k))}, '-0.0', '0.0') = replace({value(last('b', k))}, '-0.0', '0.0')" for k in ("k1", "k2"))
    Q["canonical_values"] = f"""SELECT doc_id, ok AS same, ok AS same_digest FROM (
        SELECT doc_id, ends_with(a, '}}') AND ends_with(b, '}}') AND {same} AS ok
        FROM (SELECT doc_id, {texts_a} AS a, {texts_b} AS b FROM documents))"""
    turn = lambda role, x: f"CASE WHEN {x} IS NULL THEN '' ELSE '<|im_start|>{role}' || chr(10) || {x} || '<|im_end|>' || chr(10) END"
    head = f"({turn('system', 'system')} || {turn('user', 'prompt')})"
    asked = (f"CASE WHEN prompt IS NULL THEN '' ELSE '[INST] ' || CASE WHEN coalesce({strip('system')}, '') <> '' "
             f"THEN {strip('system')} || chr(10) || chr(10) ELSE '' END || {strip('prompt')} || ' [/INST]' END")
    Q["chat_templates"] = sql(f"""SELECT conv_id, turn, {head} || {turn('assistant', 'completion')} || '<|im_start|>assistant' || chr(10) AS chatml,
        '<s>' || {asked} || CASE WHEN completion IS NULL THEN '' ELSE ' ' || {strip('completion')} || '</s>' END AS inst FROM pairs""", "pairs")
    Q["label_spans"] = sql(f"""SELECT conv_id, turn, 0 AS span, length(h)::INTEGER AS "begin", (length(h) + length(completion))::INTEGER AS "end",
        {tokens('h')}::INTEGER AS first_token, {tokens('completion')}::INTEGER AS n_tokens, true AS is_completion
        FROM (SELECT *, {head} || '<|im_start|>assistant' || chr(10) AS h FROM pairs) WHERE completion <> ''""", "pairs")
    Q["resumed_calls"] = (f"WITH r AS ({Q['batch_requests']}) SELECT batch_id, length(request) || ' characters' AS response, "
                          "(SELECT count(DISTINCT request) FROM r WHERE batch_id % 2 = 0)::BIGINT AS n_sent_1, "
                          "((SELECT count(DISTINCT request) FROM r) - (SELECT count(DISTINCT request) FROM r WHERE batch_id % 2 = 0))::BIGINT AS n_sent_2, "
                          "0::BIGINT AS n_sent_3 FROM r")
    Q["stored_positions"] = """SELECT row_number() OVER (ORDER BY coalesce(doc_id % 2, 1), doc_id NULLS FIRST) - 1 AS ord, doc_id,
        length(text)::BIGINT AS n_chars FROM documents"""
    Q["unbatch_colocated"] = Q["unbatch"]
    Q["snapshot_splits"] = """SELECT lang AS split, count(*)::BIGINT AS n_rows, 1::INTEGER AS version FROM documents GROUP BY lang
        UNION ALL SELECT lang, count(*)::BIGINT, 2::INTEGER FROM documents WHERE lang IS DISTINCT FROM 'en' OR length(text) >= 500 GROUP BY lang
        UNION ALL SELECT lang, count(*)::BIGINT, 3::INTEGER FROM documents WHERE lang = 'de' GROUP BY lang"""
    # ranges are in order of their starts and none reaches beyond the next one's end, so neighbours tell all
    Q["shard_coverage"] = """WITH r AS (SELECT doc_id * 10 AS s, doc_id * 10 + 10 + CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0 END
            - CASE WHEN doc_id % 11 = 0 THEN 4 ELSE 0 END AS e FROM documents),
        t AS (SELECT max(s) + 10 AS total FROM r),
        n AS (SELECT s, e, lead(s) OVER (ORDER BY s) AS nxt, total FROM r, t)
        SELECT 'gap' AS kind, 0::BIGINT AS "begin", min(s)::BIGINT AS finish, 0::BIGINT AS depth FROM r HAVING min(s) > 0
        UNION ALL SELECT 'gap', e::BIGINT, coalesce(nxt, total)::BIGINT, 0::BIGINT FROM n WHERE e < coalesce(nxt, total)
        UNION ALL SELECT 'overlap', nxt::BIGINT, e::BIGINT, 2::BIGINT FROM n WHERE e > nxt
        UNION ALL SELECT 'outside', total::BIGINT, e::BIGINT, 1::BIGINT FROM n WHERE nxt IS NULL AND e > total"""
    Q["merged_survey"] = sql(f"""SELECT s.*, m.min_tokens, m.max_tokens FROM ({survey_row}) s,
        (SELECT min({tokens('completion')})::BIGINT AS min_tokens, max({tokens('completion')})::BIGINT AS max_tokens FROM cad_damaged) m""", "cad_damaged")
    Q["merged_histogram"] = Q["part_histogram"]
    return Q
