"""DuckDB CTE text for the corpus views (FIXTURES.md §2).

Written relationally (one row per token, self-joins) rather than with list
lambdas, so the oracle is an independent formulation of each operator.
``cte(*names)`` returns a ``WITH`` clause holding the named views and their
dependencies in order.
"""

from __future__ import annotations


def H(*parts: str) -> str:
    """The md5 draw of detflow.functions.draws in DuckDB."""
    inner = ", ".join(parts)
    return f"CAST(CAST(('0x' || substr(md5(concat_ws('-', {inner})), 1, 8)) AS UBIGINT) AS BIGINT)"


POS_CASE = """CASE
      WHEN lower(word) IN ('a','the','this','that','these','those') THEN 'DET'
      WHEN lower(word) IN ('of','in','to','for','with','on','by','from','at','as') THEN 'ADP'
      WHEN lower(word) IN ('is','are','was','were','be') THEN 'AUX'
      WHEN lower(word) IN ('and','or','but') THEN 'CCONJ'
      WHEN lower(word) IN ('it','he','she','they','you','we') THEN 'PRON'
      WHEN regexp_full_match(lower(word), '[0-9]+') THEN 'NUM'
      WHEN ends_with(lower(word), 'ly') THEN 'ADV'
      WHEN ends_with(lower(word), 'ed') OR ends_with(lower(word), 'ing') THEN 'VERB'
      WHEN ends_with(lower(word), 'ble') OR ends_with(lower(word), 'er') THEN 'ADJ'
      WHEN ascii(word) BETWEEN 65 AND 90 AND i > 0 THEN 'PROPN'
      ELSE 'NOUN' END"""

# The study's band edges.
BAND_EDGES = [0, 14, 18, 22, 26, 30, 34, 38, 42, 46, 50, 54, 58]

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


view("texts", [], """
  SELECT 'c' AS k, conv_id AS id, turn, role, text FROM conversations
  UNION ALL
  SELECT 'd' AS k, doc_id AS id, CAST(0 AS BIGINT) AS turn, 'assistant' AS role, text
  FROM documents""")

view("utt_split", ["texts"], r"""
  SELECT k, id, turn, role, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS sent_no
  FROM (SELECT k, id, turn, role, string_split_regex(text, '[.!?\n]+') AS parts FROM texts)""")

view("utterances", ["utt_split"], """
  SELECT concat_ws('-', k, id, turn, sent_no) AS uid, k, id, turn, CAST(sent_no AS BIGINT) AS sent_no,
         role, trim(s) AS utt,
         CASE WHEN id % 29 = 28 THEN NULL ELSE CAST(10 + 4 * (id % 14) AS DOUBLE) END AS age_months,
         id % 20 AS subject
  FROM utt_split WHERE trim(s) <> ''""")

view("raw_corpus", ["utterances"], f"""
  SELECT uid, k, id, turn, sent_no, role, age_months, subject,
         CASE {H('uid', "'m'")} % 20
           WHEN 2 THEN utt || ' MASK' WHEN 3 THEN utt || ' [x3]'
           WHEN 4 THEN utt || ' &8217s joe@x' WHEN 5 THEN utt || ' an An AN a+b'
           ELSE utt END AS utt
  FROM utterances
  UNION ALL
  SELECT uid || '-m' AS uid, k, id, turn, sent_no, role, age_months, subject,
         CASE {H('uid', "'m'")} % 20 WHEN 0 THEN 'MASK' ELSE 'MASK MASK' END AS utt
  FROM utterances WHERE {H('uid', "'m'")} % 20 < 2""")

view("tok_lists", ["utterances"], r"""
  SELECT uid, regexp_extract_all(utt, '[\pL\pN'']+') AS t FROM utterances""")

view("toks", ["tok_lists"], f"""
  SELECT uid, i, word, {POS_CASE} AS pos
  FROM (SELECT uid, unnest(t) AS word, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS i FROM tok_lists)""")

view("parent_u", ["utterances"], """
  SELECT * FROM utterances WHERE role = 'assistant' AND age_months IS NOT NULL""")

view("child_u", ["utterances"], """
  SELECT * FROM utterances WHERE role = 'user' AND age_months IS NOT NULL""")

view("ptoks", ["toks", "parent_u"], """
  SELECT t.* FROM toks t JOIN parent_u USING (uid)""")

view("ctoks", ["toks", "child_u"], """
  SELECT t.* FROM toks t JOIN child_u USING (uid)""")

view("names", [], f"""
  SELECT n_name AS name,
         CAST(row_number() OVER (ORDER BY {H('n_name', "'names'")}, n_name) - 1 AS BIGINT) AS idx
  FROM nation""")

view("variants", [], """
  SELECT * FROM (VALUES (0, 0.0), (25, 0.25), (50, 0.5), (75, 0.75), (100, 1.0)) v(model_type, share)""")

view("bands", [], "SELECT * FROM (VALUES " + ", ".join(
    f"({lo}, {hi})" for lo, hi in zip(BAND_EDGES[:-1], BAND_EDGES[1:])) + ") b(band_lo, band_hi)")


def register(name: str, deps: list[str], body: str) -> None:
    """Let query modules add their own reusable CTEs."""
    view(name, deps, body)


def cte(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order) + "\n"
