"""SQL of the queries on training text that SQL can express."""

from __future__ import annotations

from corvina.llm.text import CLOSING

_CLOSING = CLOSING.replace("'", "''")

P7_FOUND = rf"""
WITH l AS (SELECT id, veiculo_id, unnest(string_split(corpo, chr(10))) AS line, generate_subscripts(string_split(corpo, chr(10)), 1) AS linha FROM materias WHERE corpo IS NOT NULL),
k AS (SELECT id, veiculo_id, linha, rtrim(regexp_replace(regexp_replace(lower(line), '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', '', 'g'), '[0-9]+', '', 'g'), '{_CLOSING}') AS key FROM l),
n AS (SELECT veiculo_id, count(*) AS rows FROM materias GROUP BY 1),
f AS (SELECT k.veiculo_id, key FROM k JOIN n ON n.veiculo_id = k.veiculo_id WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.05 * any_value(rows))
SELECT k.id, k.linha::INT AS linha FROM k JOIN f ON f.veiculo_id = k.veiculo_id AND f.key = k.key
"""

_GRAMS = """SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 11), ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i
    FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(strip_accents({text})), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {table} WHERE {text} IS NOT NULL))"""

P8_FOUND = f"""WITH d AS ({_GRAMS.format(key="doc_id", text="text", table="documents")}), t AS ({_GRAMS.format(key="item_id", text="texto", table="itens_avaliacao")})
SELECT DISTINCT doc_id, item_id FROM d JOIN t ON d.gram = t.gram"""

P8_REPORT = f"""WITH f AS ({P8_FOUND}), n AS (SELECT item_id, count(DISTINCT doc_id) AS n FROM f GROUP BY 1)
SELECT conjunto, count(*) AS items, count(n) AS leaked_items, coalesce(sum(n), 0)::BIGINT AS documents FROM itens_avaliacao i LEFT JOIN n ON n.item_id = i.item_id GROUP BY 1"""

SQL = {"p7_found": P7_FOUND, "p8_found": P8_FOUND, "p8_report": P8_REPORT}
