"""DuckDB oracle SQL, one string per registered query key.

Column names and types match ``detflow.plans.catalog``.  Views come from
``oracle.views.cte``; helpers below render the per-value SQL expressions.
"""

from __future__ import annotations

from oracle.views import H, POS_CASE, cte, register

SQL: dict[str, str] = {}


def sql(key: str, text: str) -> None:
    SQL[key] = text


WORD = r"[\pL\pN_]"


def NORM(x: str) -> str:
    """P4 without lookaround: apply the boundary-capturing replace twice."""
    def once(s: str, src: str, dst: str) -> str:
        return rf"regexp_replace({s}, '(^|[^\pL\pN_]){src}([^\pL\pN_]|$)', '\1{dst}\2', 'g')"
    y = once(once(x, "an", "a"), "an", "a")
    return once(once(y, "An", "A"), "An", "A")


def CLEAN(x: str) -> str:
    return rf"regexp_replace(replace({NORM(x)}, '@', ''), '&[0-9]{{4}}', '''', 'g')"


def ONLYMASK(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g') IN ('MASK', 'MASK MASK')"


def LEMMA(w: str) -> str:
    return (f"CASE WHEN regexp_full_match({w}, '[a-z]{{4,}}') THEN CASE "
            f"WHEN ends_with({w}, 'sses') THEN left({w}, length({w}) - 4) || 'ss' "
            f"WHEN ends_with({w}, 'ies') THEN left({w}, length({w}) - 3) || 'y' "
            f"WHEN ends_with({w}, 's') AND NOT (ends_with({w}, 'ss') OR ends_with({w}, 'us') OR ends_with({w}, 'is')) "
            f"THEN left({w}, length({w}) - 1) ELSE {w} END ELSE {w} END")


register("wide", ["raw_corpus"], """
  SELECT uid, subject, age_months,
         CASE WHEN role = 'assistant' THEN utt END AS p_utts,
         CASE WHEN role = 'user' THEN utt END AS c_utts
  FROM raw_corpus WHERE role IN ('assistant', 'user')""")

register("ic", ["wide"], f"""
  SELECT uid, subject, age_months, 'parent' AS speaker, {CLEAN('p_utts')} AS utt FROM wide
  WHERE p_utts IS NOT NULL AND age_months IS NOT NULL AND NOT ({ONLYMASK('p_utts')})
  UNION ALL
  SELECT uid, subject, age_months, 'child' AS speaker, {CLEAN('c_utts')} AS utt FROM wide
  WHERE c_utts IS NOT NULL AND age_months IS NOT NULL AND NOT ({ONLYMASK('c_utts')})""")

register("ic_tok", ["ic"], r"""
  SELECT uid, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i
  FROM (SELECT uid, regexp_extract_all(utt, '\[x[0-9]+\]|[\pL\pN''+@]+') AS t FROM ic)""")

register("ic_lem", ["ic_tok"], f"""
  SELECT uid, i, {LEMMA('w')} AS w FROM ic_tok""")


def _expand(src: str) -> str:
    return rf"""
  SELECT uid, i, w, is_mark,
         CASE WHEN is_mark THEN greatest(CAST(regexp_extract(w, '[0-9]+') AS BIGINT) - 1, 0) ELSE 1 END AS cnt,
         last_value(CASE WHEN NOT is_mark THEN w END IGNORE NULLS)
           OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lit
  FROM (SELECT uid, i, w, regexp_full_match(w, '\[x0*[0-9]{{1,3}}\]') AND i > 0 AS is_mark FROM {src})"""


register("ic_exp0", ["ic_tok"], _expand("ic_tok"))
register("ic_exp", ["ic_exp0"], """
  SELECT uid, i, r, CASE WHEN is_mark THEN lit ELSE w END AS w
  FROM (SELECT *, unnest(range(cnt)) AS r FROM ic_exp0)""")
register("lem_exp0", ["ic_lem"], _expand("ic_lem"))
register("lem_exp", ["lem_exp0"], """
  SELECT uid, i, r, CASE WHEN is_mark THEN lit ELSE w END AS w
  FROM (SELECT *, unnest(range(cnt)) AS r FROM lem_exp0)""")

register("norm0", ["ic", "lem_exp"], """
  SELECT ic.uid, ic.subject, ic.age_months, ic.speaker, coalesce(j.utt, '') AS utt
  FROM ic LEFT JOIN (SELECT uid, string_agg(replace(w, '+', ''), ' ' ORDER BY i, r) AS utt
                     FROM lem_exp GROUP BY uid) j USING (uid)""")


def mask_names(src: str, cols: str) -> str:
    """T5 on view ``src`` (uid, utt, ...); returns SELECT text with ``cols`` kept."""
    return f"""
  SELECT {cols}, CASE WHEN m.uid IS NULL THEN s.utt ELSE m.utt END AS utt
  FROM {src} s LEFT JOIN (
    SELECT p.uid, string_agg(p.part || coalesce(nm.name, ''), '' ORDER BY p.k) AS utt
    FROM (SELECT uid, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS k, len(parts) AS np
          FROM (SELECT uid, string_split(regexp_replace(regexp_replace(utt,
                         '(^|[^\\pL\\pN_])MASK($|[^\\pL\\pN_])', '\\1' || chr(1) || '\\2', 'g'),
                         '(^|[^\\pL\\pN_])MASK($|[^\\pL\\pN_])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts
                FROM {src} WHERE contains(utt, 'MASK'))) p
    LEFT JOIN names nm ON p.k < p.np - 1
         AND nm.idx = {H('p.uid', 'p.k', "'name'")} % (SELECT count(*) FROM nation)
    GROUP BY p.uid) m ON m.uid = s.uid"""


register("normalized", ["norm0", "names"], mask_names("norm0", "s.uid, s.subject, s.age_months, s.speaker"))

# The study's sentences: cleaned, normalised, not empty, with the corpus order.
register("ntoks", ["normalized"], f"""
  SELECT uid, i, word, {POS_CASE} AS pos FROM (
    SELECT uid, unnest(t) AS word, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS i
    FROM (SELECT uid, regexp_extract_all(utt, '[\\pL\\pN'']+') AS t FROM normalized))""")
register("sutts", ["normalized", "utterances"], """
  SELECT u.k, u.id, u.turn, u.sent_no, n.* FROM normalized n JOIN utterances u USING (uid) WHERE trim(n.utt) <> ''""")
register("sparent_u", ["sutts"], "SELECT * FROM sutts WHERE speaker = 'parent'")
register("schild_u", ["sutts"], "SELECT * FROM sutts WHERE speaker = 'child'")
register("sptoks", ["ntoks", "sparent_u"], "SELECT t.* FROM ntoks t JOIN sparent_u USING (uid)")
register("sctoks", ["ntoks", "schild_u"], "SELECT t.* FROM ntoks t JOIN schild_u USING (uid)")

# ------------------------------------------------------------ sources
sql("src_corpus", cte("wide") + "SELECT uid, subject, age_months, p_utts, c_utts FROM wide")
sql("src_names", cte("names") + "SELECT idx, name FROM names")
sql("decode_tagged", cte("tok_lists", "toks") + """
SELECT l.uid, CAST(len(l.t) AS INTEGER) AS n_tok, array_to_string(l.t, ' ') AS words,
       coalesce(g.tags, '') AS tags
FROM tok_lists l LEFT JOIN (SELECT uid, string_agg(pos, ' ' ORDER BY i) AS tags FROM toks GROUP BY uid) g USING (uid)""")

# ------------------------------------------------------------ cleaning
sql("drop_null_utts", cte("wide") + "SELECT uid, p_utts FROM wide WHERE p_utts IS NOT NULL AND age_months IS NOT NULL")
sql("drop_only_mask", cte("wide") + f"""SELECT uid, p_utts FROM wide
WHERE p_utts IS NOT NULL AND age_months IS NOT NULL AND NOT ({ONLYMASK('p_utts')})""")
sql("split_speakers", cte("wide") + """
SELECT uid, 'parent' AS speaker, p_utts AS utt FROM wide WHERE p_utts IS NOT NULL
UNION ALL SELECT uid, 'child' AS speaker, c_utts AS utt FROM wide WHERE c_utts IS NOT NULL""")
sql("norm_article", cte("raw_corpus") + f"SELECT uid, {NORM('utt')} AS utt FROM raw_corpus")
sql("strip_at", cte("raw_corpus") + "SELECT uid, replace(utt, '@', '') AS utt FROM raw_corpus")
sql("clean_entities", cte("raw_corpus") + "SELECT uid, regexp_replace(utt, '&[0-9]{4}', '''', 'g') AS utt FROM raw_corpus")
sql("import_clean", cte("ic") + "SELECT uid, speaker, utt, age_months FROM ic")
sql("rename_select", cte("ic") + "SELECT uid, subject, age_months, utt FROM ic WHERE speaker = 'child'")
sql("pick_utt_column", cte("wide") + "SELECT uid, coalesce(p_utts, c_utts) AS utt FROM wide")
sql("drop_empty", cte("normalized") + "SELECT uid, utt FROM normalized WHERE speaker = 'parent' AND trim(utt) <> ''")
sql("age_range", cte("parent_u") + "SELECT uid, age_months FROM parent_u WHERE age_months > 14 AND age_months <= 30")
sql("age_upto", cte("parent_u") + "SELECT uid, age_months FROM parent_u WHERE age_months <= 30")

# ------------------------------------------------------------ tokens
sql("tokenize", cte("tok_lists") + "SELECT uid, CAST(len(t) AS INTEGER) AS n_tok, array_to_string(t, ' ') AS tokens FROM tok_lists")
sql("lemmatize", cte("tok_lists") + f"SELECT uid, array_to_string(list_transform(t, lambda w: {LEMMA('w')}), ' ') AS lemmas FROM tok_lists")
sql("expand_repeats", cte("ic", "ic_exp") + """
SELECT ic.uid, coalesce(j.expanded, '') AS expanded FROM ic
LEFT JOIN (SELECT uid, string_agg(w, ' ' ORDER BY i, r) AS expanded FROM ic_exp GROUP BY uid) j USING (uid)""")
sql("strip_plus_join", cte("ic", "ic_tok") + """
SELECT ic.uid, coalesce(j.utt, '') AS utt FROM ic
LEFT JOIN (SELECT uid, string_agg(replace(w, '+', ''), ' ' ORDER BY i) AS utt FROM ic_tok GROUP BY uid) j USING (uid)""")
register("rc_nomask", ["raw_corpus"], f"SELECT uid, utt FROM raw_corpus WHERE NOT ({ONLYMASK('utt')})")
sql("replace_mask_names", cte("rc_nomask", "names") + mask_names("rc_nomask", "s.uid"))
sql("replace_at_names", cte("raw_corpus", "names") + rf"""
SELECT s.uid, CASE WHEN a.uid IS NULL THEN s.utt ELSE a.utt END AS utt
FROM raw_corpus s LEFT JOIN (
  SELECT p.uid, string_agg(p.part || coalesce(nm.name, ''), '' ORDER BY p.k) AS utt
  FROM (SELECT uid, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS k, len(parts) AS np
        FROM (SELECT uid, string_split_regex(utt, '{WORD}*@{WORD}*') AS parts FROM raw_corpus
              WHERE regexp_matches(utt, '{WORD}*@{WORD}*'))) p
  LEFT JOIN names nm ON p.k < p.np - 1
       AND nm.idx = {H('p.uid', "'at'", 'p.k')} % (SELECT count(*) FROM nation)
  GROUP BY p.uid) a ON a.uid = s.uid""")
sql("normalize_utts", cte("normalized") + "SELECT uid, speaker, subject, age_months, utt FROM normalized")
sql("pos_tag", cte("tok_lists", "toks") + """
SELECT l.uid, coalesce(g.tags, '') AS tags
FROM tok_lists l LEFT JOIN (SELECT uid, string_agg(pos, ' ' ORDER BY i) AS tags FROM toks GROUP BY uid) g USING (uid)""")
sql("learn_tag_lexicon", cte("ptoks") + """
SELECT word, pos, CAST(total AS BIGINT) AS n FROM (
  SELECT word, pos, sum(n) OVER (PARTITION BY word) AS total,
         row_number() OVER (PARTITION BY word ORDER BY n DESC, pos DESC) AS rn
  FROM (SELECT lower(word) AS word, pos, count(*) AS n FROM ptoks GROUP BY 1, 2)) WHERE rn = 1""")
register("trans_n", ["ptoks"], """
  SELECT coalesce(lag(pos) OVER (PARTITION BY uid ORDER BY i), '^') AS prev, pos FROM ptoks""")
sql("tag_transitions", cte("trans_n") + "SELECT prev, pos, count(*) AS n FROM trans_n GROUP BY 1, 2")
sql("tag_decode", cte("tok_lists", "toks", "trans_n").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
tagset AS (SELECT DISTINCT pos FROM ptoks),
trans AS MATERIALIZED (
  SELECT a.prev, b.pos, CAST(round(ln((coalesce(n.n, 0) + 1) / (coalesce(t.total, 0) + k.k)) * 1000000) AS BIGINT) AS s
  FROM (SELECT pos AS prev FROM tagset UNION ALL SELECT '^') a CROSS JOIN tagset b
  CROSS JOIN (SELECT count(*) AS k FROM tagset) k
  LEFT JOIN (SELECT prev, pos, count(*) AS n FROM trans_n GROUP BY 1, 2) n ON n.prev = a.prev AND n.pos = b.pos
  LEFT JOIN (SELECT prev, count(*) AS total FROM trans_n GROUP BY 1) t ON t.prev = a.prev),
emit AS (
  SELECT w.word, w.pos, CAST(round(ln(w.n / t.total) * 1000000) AS BIGINT) AS e
  FROM (SELECT lower(word) AS word, pos, count(*) AS n FROM ptoks GROUP BY 1, 2) w
  JOIN (SELECT pos, count(*) AS total FROM ptoks GROUP BY 1) t USING (pos)),
cand AS (
  SELECT t.uid, t.i, list({'pos': coalesce(e.pos, t.pos), 'e': coalesce(e.e, 0)}) AS options
  FROM toks t LEFT JOIN emit e ON e.word = lower(t.word) GROUP BY 1, 2),
sentence AS MATERIALIZED (SELECT uid, list(options ORDER BY i) AS tokens FROM cand GROUP BY 1),
least_s AS MATERIALIZED (SELECT min(s) AS s FROM trans),
walk AS (
  SELECT uid, CAST(0 AS BIGINT) AS i, '^' AS pos, CAST(0 AS BIGINT) AS score, CAST([] AS VARCHAR[]) AS path FROM sentence
  UNION ALL
  SELECT uid, i, pos, score, path FROM (
    SELECT x.uid, x.i, x.c.pos AS pos, x.score + coalesce(t.s, l.s) + x.c.e AS score, list_append(x.path, x.c.pos) AS path,
           row_number() OVER (PARTITION BY x.uid, x.c.pos ORDER BY x.score + coalesce(t.s, l.s) DESC, x.prev) AS rn
    FROM (SELECT v.uid, v.i + 1 AS i, v.pos AS prev, v.score, v.path, unnest(s.tokens[v.i + 1]) AS c
          FROM walk v JOIN sentence s USING (uid) WHERE v.i < len(s.tokens)) x
    CROSS JOIN least_s l LEFT JOIN trans t ON t.prev = x.prev AND t.pos = x.c.pos) WHERE rn = 1),
ends AS (
  SELECT uid, path, score FROM (
    SELECT w.*, row_number() OVER (PARTITION BY w.uid ORDER BY w.i DESC, w.score DESC, w.pos) AS rn FROM walk w) WHERE rn = 1)
SELECT l.uid, coalesce(array_to_string(e.path, ' '), '') AS tags, coalesce(e.score, 0) AS score
FROM tok_lists l LEFT JOIN ends e USING (uid)""")
sql("words_join", cte("tok_lists") + "SELECT uid, array_to_string(t, ' ') AS utt FROM tok_lists")

# ------------------------------------------------------------ pairing
def first_pair(toks: str, det_cond: str, target_cond: str, ahead: str, ok: str = "true", keys: str = "uid") -> str:
    """The first token behind a determiner for which ``target_cond`` holds, within
    ``ahead`` tokens, kept if ``ok`` holds for it; one window over the tokens."""
    return f"""
SELECT {keys}, det_idx, det, hit.i AS noun_idx, hit.noun AS noun FROM (
  SELECT {keys}, i AS det_idx, lower(word) AS det, {det_cond} AS is_det,
         min({{'i': i, 'noun': lower(word), 'pos': pos}}) FILTER (WHERE {target_cond}) OVER (
           PARTITION BY {keys} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {ahead} FOLLOWING) AS hit
  FROM {toks}) WHERE is_det AND hit IS NOT NULL AND {ok}"""


DET_TAGGED = "(pos = 'DET' AND lower(word) IN ('a', 'the'))"
DET_WORD = "(lower(word) IN ('a', 'the'))"
STOPS = "NOT (starts_with(pos, 'ADJ') OR starts_with(pos, 'VERB'))"
sql("pair_assign", cte("ptoks") + first_pair("ptoks", DET_TAGGED, "pos = 'NOUN'", "4"))
sql("pair_unbounded", cte("ptoks") + first_pair("ptoks", DET_TAGGED, "pos IN ('NOUN', 'PROPN')", "UNBOUNDED"))
sql("pair_train2", cte("ptoks") + first_pair("ptoks", DET_TAGGED, "pos = 'NOUN'", "2"))
sql("pair_checking", cte("ptoks") + first_pair("ptoks", DET_WORD, STOPS, "4", "starts_with(hit.pos, 'NOUN')"))
sql("pair_eval", cte("ctoks") + """
SELECT d.uid, d.i AS det_idx, lower(d.word) AS det,
       CASE WHEN starts_with(t1.pos, 'NOUN') THEN d.i + 1 ELSE d.i + 2 END AS noun_idx,
       lower(CASE WHEN starts_with(t1.pos, 'NOUN') THEN t1.word ELSE t2.word END) AS noun
FROM ctoks d LEFT JOIN ctoks t1 ON t1.uid = d.uid AND t1.i = d.i + 1
LEFT JOIN ctoks t2 ON t2.uid = d.uid AND t2.i = d.i + 2
WHERE lower(d.word) IN ('a', 'the')
  AND (starts_with(t1.pos, 'NOUN') OR (t1.pos <> 'NOUN' AND starts_with(t2.pos, 'NOUN')))""")
register("ftoks", ["toks", "utterances"], """
  SELECT t.* FROM toks t JOIN utterances u USING (uid)
  WHERE u.age_months IS NOT NULL AND u.role IN ('user', 'assistant')""")
sql("pair_flex", cte("ftoks") + """
SELECT uid, det_idx, det, det_idx + o AS noun_idx, lower(CASE WHEN o = 1 THEN w1 ELSE w2 END) AS noun FROM (
  SELECT uid, i AS det_idx, lower(word) AS det, pos, unnest([1, 2]) AS o,
         lead(word, 1) OVER w AS w1, lead(pos, 1) OVER w AS p1, lead(word, 2) OVER w AS w2, lead(pos, 2) OVER w AS p2
  FROM ftoks WINDOW w AS (PARTITION BY uid ORDER BY i))
WHERE pos = 'DET' AND CASE WHEN o = 1 THEN p1 ELSE p2 END = 'NOUN'""")

# ------------------------------------------------------------ filters
register("ctok3", ["sctoks"], """
  SELECT d.uid, d.i, d.word, d.pos, t1.pos AS p1, t2.pos AS p2, t1.word AS w1, t2.word AS w2
  FROM sctoks d LEFT JOIN sctoks t1 ON t1.uid = d.uid AND t1.i = d.i + 1
  LEFT JOIN sctoks t2 ON t2.uid = d.uid AND t2.i = d.i + 2""")
sql("filter_det_noun", cte("schild_u", "ctok3") + """
SELECT uid, utt FROM schild_u WHERE uid IN (
  SELECT uid FROM ctok3 WHERE pos = 'DET' AND lower(word) IN ('a', 'the')
    AND (p1 = 'NOUN' OR (p1 NOT IN ('DET', 'NOUN') AND p2 = 'NOUN')))""")
sql("filter_any_det_x_noun", cte("schild_u", "ctok3") + """
SELECT uid, utt FROM schild_u WHERE uid IN (
  SELECT uid FROM ctok3 WHERE pos = 'DET' AND (p1 = 'NOUN' OR p2 = 'NOUN'))""")
sql("one_det_only", cte("schild_u", "sctoks") + """
SELECT uid, utt FROM schild_u WHERE uid IN (
  SELECT uid FROM sctoks WHERE lower(word) IN ('a', 'the') GROUP BY uid HAVING count(*) = 1)""")
register("d5", ["sctoks"], """
  SELECT d.uid, d.i AS det_idx, lower(d.word) AS det,
         CASE WHEN starts_with(t1.pos, 'NOUN') THEN d.i + 1 ELSE d.i + 2 END AS noun_idx,
         lower(CASE WHEN starts_with(t1.pos, 'NOUN') THEN t1.word ELSE t2.word END) AS noun
  FROM sctoks d LEFT JOIN sctoks t1 ON t1.uid = d.uid AND t1.i = d.i + 1
  LEFT JOIN sctoks t2 ON t2.uid = d.uid AND t2.i = d.i + 2
  WHERE lower(d.word) IN ('a', 'the')
    AND (starts_with(t1.pos, 'NOUN') OR (t1.pos <> 'NOUN' AND starts_with(t2.pos, 'NOUN')))""")
sql("one_candidate", cte("d5") + """
SELECT uid, det_idx, noun FROM d5 WHERE uid IN (SELECT uid FROM d5 GROUP BY uid HAVING count(*) = 1)""")

# ------------------------------------------------------------ assignment
register("d1", ["sptoks"], first_pair("sptoks", DET_TAGGED, "pos = 'NOUN'", "4"))
register("raw_types", ["d1"], """
  SELECT noun, string_agg(DISTINCT t, ',' ORDER BY t) AS types
  FROM (SELECT noun, CASE WHEN det = 'a' THEN 'A' ELSE 'B' END AS t FROM d1) GROUP BY noun""")
register("both_v", ["raw_types", "variants"], """
  SELECT v.model_type, v.share, r.noun FROM raw_types r CROSS JOIN variants v WHERE r.types = 'A,B'""")
register("kept", ["both_v"], f"""
  SELECT model_type, noun FROM (
    SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY {H('noun', "'keep'", 'model_type')}, noun) - 1 AS rk,
           count(*) OVER (PARTITION BY model_type) AS nb FROM both_v)
  WHERE rk < floor(nb * CAST(share AS DOUBLE))""")
register("nt", ["raw_types", "variants", "kept"], f"""
  SELECT v.model_type, r.noun,
         CASE WHEN r.types = 'A,B' AND k.noun IS NULL
              THEN CASE WHEN {H('r.noun', "'pick'", 'v.model_type')} % 2 = 0 THEN 'A' ELSE 'B' END
              ELSE r.types END AS types
  FROM raw_types r CROSS JOIN variants v
  LEFT JOIN kept k ON k.model_type = v.model_type AND k.noun = r.noun""")
register("ex", ["nt"], f"""
  SELECT model_type, types AS type, noun,
         row_number() OVER (PARTITION BY model_type, types ORDER BY {H('noun', "'ex'", 'model_type')}, noun) - 1 AS idx,
         count(*) OVER (PARTITION BY model_type, types) AS n
  FROM nt WHERE types <> 'A,B'""")

sql("noun_types_raw", cte("raw_types") + "SELECT noun, types FROM raw_types")
sql("assign_types", cte("raw_types") + f"""
SELECT noun, CASE WHEN types = 'A,B' AND noun NOT IN (
    SELECT noun FROM (SELECT noun, row_number() OVER (ORDER BY {H('noun', "'keep'", '25')}, noun) - 1 AS rk,
                             count(*) OVER () AS nb FROM raw_types WHERE types = 'A,B') WHERE rk < floor(nb * 0.25))
  THEN CASE WHEN {H('noun', "'pick'", '25')} % 2 = 0 THEN 'A' ELSE 'B' END ELSE types END AS types
FROM raw_types""")
sql("assign_all_variants", cte("nt") + "SELECT model_type, noun, types FROM nt")
sql("pick_share", cte("kept") + "SELECT model_type, noun FROM kept")
sql("dense_index", cte("ex") + "SELECT model_type, type, noun, CAST(idx AS BIGINT) AS idx FROM ex")
sql("invert_types", cte("nt") + "SELECT model_type, types AS type, noun FROM nt WHERE types <> 'A,B'")
sql("set_difference", cte("both_v", "kept") + """
SELECT model_type, noun FROM both_v EXCEPT SELECT model_type, noun FROM kept""")
sql("exclusive_sets", cte("nt") + """
SELECT model_type, CASE WHEN types = 'A,B' THEN 'both' ELSE types END AS category, count(*) AS n_nouns
FROM nt GROUP BY 1, 2""")
register("d3", ["ptoks"], first_pair("ptoks", DET_TAGGED, "pos IN ('NOUN', 'PROPN')", "UNBOUNDED"))
register("ndc", ["d3"], """
  SELECT noun, count(*) FILTER (WHERE det = 'a') AS n_a, count(*) FILTER (WHERE det = 'the') AS n_the
  FROM d3 GROUP BY noun""")
sql("noun_det_counts", cte("ndc") + "SELECT noun, n_a, n_the FROM ndc")
sql("noun_det_partition", cte("ndc") + """
SELECT count(*) FILTER (WHERE n_a > 0 AND n_the > 0) AS both_count,
       count(*) FILTER (WHERE n_a > 0 AND n_the = 0) AS only_a_count,
       count(*) FILTER (WHERE n_a = 0 AND n_the > 0) AS only_the_count FROM ndc""")
sql("nouns_with_both", cte("ndc") + "SELECT noun, n_a, n_the FROM ndc WHERE n_a > 0 AND n_the > 0")
sql("distinct_nouns", cte("ptoks") + "SELECT DISTINCT lower(word) AS noun FROM ptoks WHERE pos = 'NOUN'")


# ------------------------------------------------------------ rewriting
def rewrite_views(p: str, tv: str, tv_deps: list[str], remove: bool, pass_no: int) -> str:
    """Register CTEs {p}_win .. {p}_out for one rewrite pass over token view
    ``tv`` (model_type, uid, i, word, pos); returns the output view name."""
    register(f"{p}_win", [*tv_deps, "nt"], f"""
  SELECT d.model_type, d.uid, d.i AS det_idx, CASE WHEN lower(d.word) = 'a' THEN 'A' ELSE 'B' END AS det_type,
         w.i AS j, w.word
  FROM {tv} d JOIN {tv} w ON w.model_type = d.model_type AND w.uid = d.uid AND w.i BETWEEN d.i + 1 AND d.i + 3
  WHERE d.pos = 'DET' AND lower(d.word) IN ('a', 'the')""")
    register(f"{p}_dec", [f"{p}_win"], f"""
  SELECT *, CASE WHEN n = 1 THEN CASE WHEN t1 <> 'A,B' THEN t1 ELSE det_type END
                 WHEN t1 = 'A,B' AND t2 = 'A,B' THEN det_type
                 WHEN t1 = 'A,B' THEN t2
                 ELSE t1 END AS final_type,
            (n >= 2 AND t1 <> 'A,B' AND t2 <> 'A,B' AND t1 <> t2) AS conflict
  FROM (SELECT model_type, uid, det_idx, det_type, count(*) AS n,
               max(CASE WHEN rk = 1 THEN types END) AS t1, max(CASE WHEN rk = 2 THEN types END) AS t2,
               max(CASE WHEN rk = 1 THEN lower(word) END) AS word1, max(CASE WHEN rk = 2 THEN j END) AS j2
        FROM (SELECT x.*, nt.types,
                     row_number() OVER (PARTITION BY x.model_type, x.uid, x.det_idx ORDER BY x.j) AS rk
              FROM {p}_win x JOIN nt ON nt.model_type = x.model_type AND nt.noun = lower(x.word))
        GROUP BY 1, 2, 3, 4)""")
    hh = H("c.uid", "c.det_idx", "'swap'", "c.model_type", str(pass_no))
    register(f"{p}_swap", [f"{p}_dec", "ex"], f"""
  SELECT c.model_type, c.uid, c.det_idx AS prio, c.j2 AS pos, e2.noun AS new_word
  FROM {p}_dec c
  JOIN ex e1 ON e1.model_type = c.model_type AND e1.type = c.final_type AND e1.noun = c.word1
  JOIN ex e2 ON e2.model_type = c.model_type AND e2.type = c.final_type
       AND e2.idx = CASE WHEN {hh} % (e1.n - 1) >= e1.idx THEN {hh} % (e1.n - 1) + 1 ELSE {hh} % (e1.n - 1) END
  WHERE c.conflict AND e1.n > 1""")
    swap = "" if remove else f" UNION ALL SELECT model_type, uid, pos, new_word, prio FROM {p}_swap"
    register(f"{p}_edits", [f"{p}_dec"] + ([] if remove else [f"{p}_swap"]), f"""
  SELECT model_type, uid, pos, arg_max(new_word, prio) AS new_word FROM (
    SELECT model_type, uid, det_idx AS pos, CASE WHEN final_type = 'A' THEN 'a' ELSE 'the' END AS new_word,
           det_idx AS prio
    FROM {p}_dec WHERE final_type <> det_type{swap}) GROUP BY 1, 2, 3""")
    drop = (f" WHERE (t.model_type, t.uid) NOT IN (SELECT model_type, uid FROM {p}_dec WHERE conflict)"
            if remove else "")
    register(f"{p}_out", [tv, f"{p}_edits"], f"""
  SELECT * FROM (
    SELECT t.model_type, t.uid, string_agg(coalesce(e.new_word, t.word), ' ' ORDER BY t.i) AS utt
    FROM {tv} t LEFT JOIN {p}_edits e ON e.model_type = t.model_type AND e.uid = t.uid AND e.pos = t.i{drop}
    GROUP BY 1, 2) WHERE trim(utt) <> ''""")
    return f"{p}_out"


register("ptoks_v", ["sptoks"], """
  SELECT v.model_type, t.* FROM sptoks t CROSS JOIN (VALUES (0), (25), (50), (75)) v(model_type)""")
rw1 = rewrite_views("rw1", "ptoks_v", ["ptoks_v"], False, 1)
rr1 = rewrite_views("rr1", "ptoks_v", ["ptoks_v"], True, 1)
register("rw1_toks", [rw1], f"""
  SELECT model_type, uid, i, word, {POS_CASE} AS pos FROM (
    SELECT model_type, uid, unnest(t) AS word, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS i
    FROM (SELECT model_type, uid, regexp_extract_all(utt, '[\\pL\\pN'']+') AS t FROM {rw1}))""")
rw2 = rewrite_views("rw2", "rw1_toks", ["rw1_toks"], False, 2)

sql("join_noun_types", cte("rw1_win") + """
SELECT x.model_type, x.uid, x.det_idx, x.j, lower(x.word) AS noun, nt.types
FROM rw1_win x JOIN nt ON nt.model_type = x.model_type AND nt.noun = lower(x.word)""")
sql("sample_replacement", cte("rw1_swap") + "SELECT model_type, uid, prio, pos, new_word FROM rw1_swap")
sql("conflict_count", cte("rw1_dec") + """
SELECT model_type, count(*) AS conflicts_adapt, count(DISTINCT uid) AS conflicts_remove
FROM rw1_dec WHERE conflict GROUP BY model_type""")
sql("rewrite_pairs", cte(rw1) + f"SELECT model_type, uid, utt FROM {rw1}")
sql("rewrite_remove", cte(rr1) + f"SELECT model_type, uid, utt FROM {rr1}")
sql("rewrite_iterate", cte(rw2) + f"SELECT model_type, uid, utt FROM {rw2}")

# ------------------------------------------------------------ bands / test sets
register("band_parent", ["parent_u", "bands"], """
  SELECT p.*, b.band_hi FROM parent_u p JOIN bands b ON p.age_months > b.band_lo AND p.age_months <= b.band_hi""")
register("study", [rr1, "sparent_u"], f"""
  SELECT r.model_type, r.uid, r.utt, p.age_months FROM {rr1} r JOIN sparent_u p USING (uid)
  UNION ALL SELECT 100 AS model_type, uid, utt, age_months FROM sparent_u""")
register("tb", ["study", "bands"], """
  SELECT s.*, b.band_hi FROM study s JOIN bands b ON s.age_months > b.band_lo AND s.age_months <= b.band_hi""")
register("tbt", ["tb"], f"""
  SELECT model_type, band_hi, uid, i, word, {POS_CASE} AS pos FROM (
    SELECT model_type, band_hi, uid, unnest(t) AS word, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS i
    FROM (SELECT model_type, band_hi, uid, regexp_extract_all(utt, '[\\pL\\pN'']+') AS t FROM tb))""")
register("d2b", ["tbt"], """
  SELECT s.model_type, s.band_hi, s.uid, s.det, lower(t.word) AS noun FROM (
    SELECT d.model_type, d.band_hi, d.uid, d.i AS det_idx, lower(d.word) AS det, min(n.i) AS stop_idx
    FROM tbt d JOIN tbt n ON n.model_type = d.model_type AND n.uid = d.uid AND n.i > d.i AND n.i <= d.i + 4
         AND NOT (starts_with(n.pos, 'ADJ') OR starts_with(n.pos, 'VERB'))
    WHERE lower(d.word) IN ('a', 'the') GROUP BY 1, 2, 3, 4, 5) s
  JOIN tbt t ON t.model_type = s.model_type AND t.uid = s.uid AND t.i = s.stop_idx
  WHERE starts_with(t.pos, 'NOUN')""")
register("dsets", ["d2b"], """
  SELECT model_type, band_hi, noun, string_agg(DISTINCT det, ',' ORDER BY det) AS dets,
         CASE WHEN string_agg(DISTINCT det, ',' ORDER BY det) = 'a,the' THEN 'both'
              WHEN string_agg(DISTINCT det, ',' ORDER BY det) = 'a' THEN 'only_a' ELSE 'only_the' END AS category
  FROM d2b GROUP BY 1, 2, 3""")
register("dsets_rk", ["dsets"], """
  SELECT *, row_number() OVER (PARTITION BY model_type, band_hi, category ORDER BY noun) AS rk FROM dsets""")

sql("bin_join", cte("band_parent") + "SELECT uid, band_hi FROM band_parent")
sql("bands_range_join", cte("parent_u", "bands") + """
SELECT b.band_hi AS age, p.uid FROM parent_u p JOIN bands b ON p.age_months <= b.band_hi""")
sql("rewrite_all_variants", cte("study") + "SELECT model_type, uid, utt FROM study")
sql("build_training_bands", cte("tb") + "SELECT model_type, band_hi, uid, utt FROM tb")
sql("noun_det_sets", cte("dsets") + "SELECT model_type, band_hi, noun, dets FROM dsets")
sql("usage_summary", cte("dsets_rk") + """
SELECT c.model_type, c.band_hi, c.total, c.only_a, c.only_the, c.both,
       max(CASE WHEN e.category = 'only_a' THEN e.examples END) AS ex_only_a,
       max(CASE WHEN e.category = 'only_the' THEN e.examples END) AS ex_only_the,
       max(CASE WHEN e.category = 'both' THEN e.examples END) AS ex_both
FROM (SELECT model_type, band_hi, count(*) AS total,
             count(*) FILTER (WHERE category = 'only_a') AS only_a,
             count(*) FILTER (WHERE category = 'only_the') AS only_the,
             count(*) FILTER (WHERE category = 'both') AS both
      FROM dsets GROUP BY 1, 2) c
LEFT JOIN (SELECT model_type, band_hi, category,
                  string_agg(noun, ', ' ORDER BY noun) FILTER (WHERE rk <= 10)
                  || CASE WHEN max(rk) > 10 THEN '...' ELSE '' END AS examples
           FROM dsets_rk GROUP BY 1, 2, 3) e USING (model_type, band_hi)
GROUP BY 1, 2, 3, 4, 5, 6""")
sql("first_k_examples", cte("dsets_rk") + """
SELECT model_type, band_hi, category, CAST(rk AS INTEGER) AS rank, noun FROM dsets_rk WHERE rk <= 10""")

register("d4", ["sptoks"], first_pair("sptoks", DET_TAGGED, "pos = 'NOUN'", "2"))
register("tmin", ["d4", "sparent_u"], """
  SELECT noun, min(age_months) AS min_age FROM d4 JOIN sparent_u USING (uid) GROUP BY noun""")
register("train_nouns", ["tmin", "bands"], """
  SELECT b.band_hi AS age, t.noun FROM tmin t JOIN bands b ON t.min_age <= b.band_hi""")
register("target", ["nt", "train_nouns"], """
  SELECT nt.model_type, t.age, t.noun FROM nt JOIN train_nouns t USING (noun) WHERE nt.types <> 'A,B'""")
register("ccand", ["sctoks"], """
  SELECT d.uid, 2 * d.i + (n.i - d.i) AS r, lower(n.word) AS noun
  FROM sctoks d JOIN sctoks n ON n.uid = d.uid AND n.i IN (d.i + 1, d.i + 2) AND n.pos = 'NOUN'
  WHERE d.pos = 'DET' AND lower(d.word) IN ('a', 'the')""")
register("decide", ["ccand", "target"], """
  SELECT model_type, age, uid, arg_min(noun, r) AS noun FROM ccand JOIN target USING (noun) GROUP BY 1, 2, 3""")
register("testset", ["decide", "schild_u"], """
  SELECT model_type, age, noun, uid FROM (
    SELECT d.*, row_number() OVER (PARTITION BY d.model_type, d.age, d.noun
                                   ORDER BY u.k, u.id, u.turn, u.sent_no, u.uid) AS rn
    FROM decide d JOIN schild_u u USING (uid)) WHERE rn = 1""")

sql("training_nouns_by_band", cte("train_nouns") + "SELECT age, noun FROM train_nouns")
sql("semi_training_nouns", cte("target") + "SELECT model_type, age, noun FROM target")
sql("set_intersect", cte("target") + "SELECT model_type, age, noun FROM target")
sql("first_per_noun", cte("testset") + "SELECT model_type, age, noun, uid FROM testset")
sql("make_test_sets", cte("testset", "schild_u") + """
SELECT t.model_type, t.age, t.uid, t.noun, u.utt, u.age_months FROM testset t JOIN schild_u u USING (uid)""")
sql("deciding_sentences", cte("decide") + "SELECT model_type, age, uid, noun FROM decide")

# ------------------------------------------------------------ prediction + evaluation
register("tri", ["tbt"], """
  SELECT model_type, band_hi, lower(word) AS word,
         coalesce(lag(lower(word)) OVER w, '[CLS]') AS prev,
         coalesce(lead(lower(word)) OVER w, '[SEP]') AS next
  FROM tbt WINDOW w AS (PARTITION BY model_type, uid ORDER BY i)""")
register("d5one", ["d5"], "SELECT * FROM d5 WHERE uid IN (SELECT uid FROM d5 GROUP BY uid HAVING count(*) = 1)")
register("qc", ["testset", "d5one", "sctoks"], """
  SELECT t.model_type, t.age, t.uid, c.det_idx, c.noun, lower(dw.word) AS actual_det,
         coalesce(lower(pw.word), '[CLS]') AS prev, coalesce(lower(nw.word), '[SEP]') AS next
  FROM testset t JOIN d5one c USING (uid)
  JOIN sctoks dw ON dw.uid = t.uid AND dw.i = c.det_idx
  LEFT JOIN sctoks pw ON pw.uid = t.uid AND pw.i = c.det_idx - 1
  LEFT JOIN sctoks nw ON nw.uid = t.uid AND nw.i = c.det_idx + 1""")
register("qg", ["qc", "nt"], """
  SELECT q.*, CASE WHEN contains(nt.types, 'A') THEN 'a' ELSE 'the' END AS gold_det
  FROM qc q JOIN nt ON nt.model_type = q.model_type AND nt.noun = q.noun""")


def level_sql(cols: list[str], out: str, qv: str = "qg") -> str:
    keys = ", ".join(f"c.{c}" for c in cols)
    on = " AND ".join(f"t.{c} = c.{c}" for c in cols)
    return f"""
  SELECT model_type, age, {', '.join(cols)}, word AS {out} FROM (
    SELECT c.model_type, c.age, {keys}, t.word,
           row_number() OVER (PARTITION BY c.model_type, c.age, {keys} ORDER BY count(*) DESC, t.word) AS rn
    FROM (SELECT DISTINCT model_type, age, {', '.join(cols)} FROM {qv}) c
    JOIN tri t ON t.model_type = c.model_type AND {on} AND t.band_hi <= c.age
    GROUP BY c.model_type, c.age, {keys}, t.word) WHERE rn = 1"""


def predict_views(p: str, qv: str) -> str:
    """Register {p}_l1..{p}_l4 and {p}_sc: backoff predictions for query view qv
    (model_type, age, prev, next, ...)."""
    register(f"{p}_l1", [qv, "tri"], level_sql(["prev", "next"], "p1", qv))
    register(f"{p}_l2", [qv, "tri"], level_sql(["next"], "p2", qv))
    register(f"{p}_l3", [qv, "tri"], level_sql(["prev"], "p3", qv))
    register(f"{p}_l4", [qv, "tri"], f"""
  SELECT model_type, age, word AS p4 FROM (
    SELECT c.model_type, c.age, t.word,
           row_number() OVER (PARTITION BY c.model_type, c.age ORDER BY count(*) DESC, t.word) AS rn
    FROM (SELECT DISTINCT model_type, age FROM {qv}) c
    JOIN tri t ON t.model_type = c.model_type AND t.band_hi <= c.age GROUP BY 1, 2, 3) WHERE rn = 1""")
    register(f"{p}_sc", [f"{p}_l1", f"{p}_l2", f"{p}_l3", f"{p}_l4"], f"""
  SELECT q.*, coalesce(p1, p2, p3, p4) AS pred_word,
         CASE WHEN coalesce(p1, p2, p3, p4) IN ('a', 'the') THEN coalesce(p1, p2, p3, p4) ELSE 'other' END AS pred_det
  FROM {qv} q LEFT JOIN {p}_l1 USING (model_type, age, prev, next) LEFT JOIN {p}_l2 USING (model_type, age, next)
  LEFT JOIN {p}_l3 USING (model_type, age, prev) LEFT JOIN {p}_l4 USING (model_type, age)""")
    return f"{p}_sc"


predict_views("ev", "qg")
register("sc", ["ev_sc"], "SELECT * FROM ev_sc")
register("cnt", ["sc", "testset", "variants", "bands"], """
  SELECT g.model_type, g.age,
         coalesce(s.a_predictions, 0) AS a_predictions, coalesce(s.the_predictions, 0) AS the_predictions,
         coalesce(tot.total_predictions, 0) AS total_predictions,
         coalesce(s.a_to_the, 0) AS a_to_the, coalesce(s.the_to_a, 0) AS the_to_a,
         coalesce(s.pred_a_or_the, 0) AS pred_a_or_the, coalesce(s.correct, 0) AS correct
  FROM (SELECT v.model_type, b.band_hi AS age FROM variants v CROSS JOIN bands b) g
  LEFT JOIN (SELECT model_type, age, count(*) AS total_predictions FROM testset GROUP BY 1, 2) tot
    USING (model_type, age)
  LEFT JOIN (SELECT model_type, age,
                    count(*) FILTER (WHERE pred_det = 'a') AS a_predictions,
                    count(*) FILTER (WHERE pred_det = 'the') AS the_predictions,
                    count(*) FILTER (WHERE gold_det = 'a' AND pred_det = 'the') AS a_to_the,
                    count(*) FILTER (WHERE gold_det = 'the' AND pred_det = 'a') AS the_to_a,
                    count(*) AS pred_a_or_the,
                    count(*) FILTER (WHERE pred_det = actual_det) AS correct
             FROM sc WHERE pred_det IN ('a', 'the') GROUP BY 1, 2) s USING (model_type, age)""")


def RATIO(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE 0.0 END"


register("res", ["cnt"], f"""
  SELECT model_type, age, a_predictions, the_predictions, total_predictions, a_to_the, the_to_a, pred_a_or_the,
         {RATIO('a_to_the', 'pred_a_or_the')} AS a_to_the_ratio,
         {RATIO('the_to_a', 'pred_a_or_the')} AS the_to_a_ratio,
         {RATIO('a_to_the + the_to_a', 'pred_a_or_the')} AS total_misclassified,
         {RATIO('correct', 'total_predictions')} AS overall_accuracy,
         {RATIO('correct', 'pred_a_or_the')} AS determiner_accuracy
  FROM cnt""")

sql("mask_candidate_det", cte("qc", "sctoks") + """
SELECT q.model_type, q.age, q.uid, q.actual_det,
       string_agg(CASE WHEN t.i = q.det_idx THEN '[MASK]' ELSE t.word END, ' ' ORDER BY t.i) AS masked, q.noun
FROM qc q JOIN sctoks t USING (uid) GROUP BY q.model_type, q.age, q.uid, q.actual_det, q.noun""")
sql("has_noun_type", cte("qg") + "SELECT model_type, age, uid, noun FROM qg")
sql("join_gold", cte("qg") + "SELECT model_type, age, uid, noun, gold_det FROM qg")
sql("argmax_prediction", cte("sc") + "SELECT model_type, age, uid, pred_word FROM sc")
sql("predict_masked", cte("sc") + "SELECT model_type, age, uid, pred_det FROM sc")
sql("eval_counters", cte("cnt") + "SELECT * FROM cnt")
sql("eval_ratios", cte("res") + "SELECT * FROM res")
sql("evaluate_variants", cte("res") + "SELECT * FROM res")
sql("sort_results", cte("res") + "SELECT * FROM res ORDER BY model_type, age")
sql("summary_stats", cte("res") + """
SELECT model_type,
       round(avg(total_misclassified), 9) AS misclass_mean, round(stddev_samp(total_misclassified), 9) AS misclass_std,
       round(avg(determiner_accuracy), 9) AS det_acc_mean, round(stddev_samp(determiner_accuracy), 9) AS det_acc_std,
       round(avg(overall_accuracy), 9) AS overall_acc_mean, round(stddev_samp(overall_accuracy), 9) AS overall_acc_std,
       CAST(sum(pred_a_or_the) AS BIGINT) AS total_determiner_preds, CAST(sum(total_predictions) AS BIGINT) AS total_preds
FROM res GROUP BY model_type""")


def SIMPSON(a: str, b: str, df: str, n: int = 2000) -> str:
    step = f"(({b}) - ({a})) / {n}"
    return (f"(list_sum(list_transform(range(0, {n + 1}), lambda k: "
            f"(CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * "
            f"pow(cos(({a}) + k * {step}), ({df}) - 1))) * {step} / 3)")


register("mom", ["res"], """
  SELECT model_type, count(*) AS n, avg(total_misclassified) AS m, var_samp(total_misclassified) AS v
  FROM res WHERE total_misclassified IS NOT NULL GROUP BY model_type""")
register("welch", ["mom"], """
  SELECT model_type_1, model_type_2, t_stat, dof FROM (
    SELECT a.model_type AS model_type_1, b.model_type AS model_type_2,
           CASE WHEN a.v / a.n + b.v / b.n = 0 THEN NULL ELSE (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) END AS t_stat,
           CASE WHEN (a.v / a.n) ^ 2 / (a.n - 1) + (b.v / b.n) ^ 2 / (b.n - 1) = 0 THEN NULL
                ELSE (a.v / a.n + b.v / b.n) ^ 2 / ((a.v / a.n) ^ 2 / (a.n - 1) + (b.v / b.n) ^ 2 / (b.n - 1)) END AS dof
    FROM mom a JOIN mom b ON a.model_type < b.model_type)""")
sql("welch_ttest", cte("welch") + f"""
SELECT model_type_1, model_type_2, round(t_stat, 9) AS t_stat,
       round({SIMPSON('atan(abs(t_stat) / sqrt(dof))', 'pi() / 2', 'dof')} / {SIMPSON('0', 'pi() / 2', 'dof')}, 9) AS p_value
FROM welch""")
sql("pairwise_models", cte("res") + """
SELECT a.model_type AS model_type_1, b.model_type AS model_type_2
FROM (SELECT DISTINCT model_type FROM res) a JOIN (SELECT DISTINCT model_type FROM res) b ON a.model_type < b.model_type""")
sql("coerce_numeric", cte("res") + """
SELECT model_type, age, TRY_CAST(CAST(total_misclassified AS VARCHAR) AS DOUBLE) AS total_misclassified
FROM res WHERE TRY_CAST(CAST(total_misclassified AS VARCHAR) AS DOUBLE) IS NOT NULL""")

# ------------------------------------------------------------ children vs model
register("ov_uid", ["sctoks"], """
  SELECT DISTINCT d.uid FROM sctoks d
  LEFT JOIN sctoks t1 ON t1.uid = d.uid AND t1.i = d.i + 1 LEFT JOIN sctoks t2 ON t2.uid = d.uid AND t2.i = d.i + 2
  WHERE d.pos = 'DET' AND (t1.pos = 'NOUN' OR t2.pos = 'NOUN')""")
register("overall", ["normalized", "ov_uid"], "SELECT * FROM normalized WHERE uid IN (SELECT uid FROM ov_uid)")
register("otoks", ["ntoks", "ov_uid"], "SELECT * FROM ntoks WHERE uid IN (SELECT uid FROM ov_uid)")


def flex_sql(toks: str, rows: str) -> str:
    """A11 over token view ``toks`` (uid, i, word, pos) of sentence view ``rows``."""
    return f"""
  SELECT g.age_months, g.subject, coalesce(c.n_flex, 0) AS n_flex
  FROM (SELECT DISTINCT age_months, subject FROM {rows}) g
  LEFT JOIN (SELECT age_months, subject, count(*) AS n_flex FROM (
               SELECT o.age_months, o.subject, p.noun FROM (
                 SELECT d.uid, lower(d.word) AS det, lower(n.word) AS noun
                 FROM {toks} d JOIN {toks} n ON n.uid = d.uid AND n.i IN (d.i + 1, d.i + 2) AND n.pos = 'NOUN'
                 WHERE d.pos = 'DET') p JOIN {rows} o USING (uid)
               GROUP BY 1, 2, 3
               HAVING count(*) FILTER (WHERE p.det = 'a') > 0 AND count(*) FILTER (WHERE p.det = 'the') > 0)
             GROUP BY 1, 2) c USING (age_months, subject)"""


def iqr_sql(flex: str) -> str:
    return f"""
  SELECT age_months, median(CAST(n_flex AS DOUBLE)) AS median,
         max(CASE WHEN rn = n // 4 THEN n_flex END) AS q1, max(CASE WHEN rn = (3 * n) // 4 THEN n_flex END) AS q3
  FROM (SELECT *, row_number() OVER (PARTITION BY age_months ORDER BY n_flex) - 1 AS rn,
               count(*) OVER (PARTITION BY age_months) AS n FROM {flex}) GROUP BY age_months"""


register("cflex", ["otoks", "overall"], flex_sql("otoks", "overall"))
register("ciqr", ["cflex"], iqr_sql("cflex"))
register("osingle", ["otoks"], """
  SELECT uid, min(i) AS det_idx FROM otoks WHERE lower(word) IN ('a', 'the') GROUP BY uid HAVING count(*) = 1""")
register("om_all", ["osingle", "overall", "otoks"], """
  SELECT o.uid, o.age_months, o.subject, s.det_idx, lower(d.word) AS gold_det,
         CASE WHEN nx.pos = 'NOUN' THEN lower(nx.word) END AS noun,
         coalesce(lower(pw.word), '[CLS]') AS prev, coalesce(lower(nx.word), '[SEP]') AS next
  FROM osingle s JOIN overall o USING (uid)
  JOIN otoks d ON d.uid = s.uid AND d.i = s.det_idx
  LEFT JOIN otoks pw ON pw.uid = s.uid AND pw.i = s.det_idx - 1
  LEFT JOIN otoks nx ON nx.uid = s.uid AND nx.i = s.det_idx + 1""")
register("om", ["om_all", "bands"], """
  SELECT *, 100 AS model_type, CAST(trunc(age_months) AS INTEGER) AS age FROM om_all
  WHERE CAST(trunc(age_months) AS INTEGER) IN (SELECT band_hi FROM bands)""")
predict_views("ov", "om")
register("mtoks", ["ov_sc", "otoks"], """
  SELECT t.uid, t.i, CASE WHEN t.i = s.det_idx THEN s.pred_det ELSE t.word END AS word, t.pos
  FROM otoks t JOIN ov_sc s USING (uid) WHERE s.pred_det IN ('a', 'the')""")
register("mrows", ["ov_sc"], "SELECT uid, age_months, subject FROM ov_sc WHERE pred_det IN ('a', 'the')")
register("mflex", ["mtoks", "mrows"], flex_sql("mtoks", "mrows"))
register("miqr", ["mflex"], iqr_sql("mflex"))
register("om58", ["om_all"], "SELECT *, 100 AS model_type, 58 AS age FROM om_all WHERE age_months <= 58")
predict_views("cm", "om58")
register("cmv", ["cm_sc"], """
  SELECT * FROM cm_sc WHERE gold_det IN ('a', 'the') AND pred_det IN ('a', 'other', 'the')""")

sql("overall_eval_set", cte("overall") + "SELECT uid, subject, age_months, utt FROM overall")
sql("mask_single_det", cte("om_all", "otoks") + """
SELECT m.uid, m.gold_det,
       string_agg(CASE WHEN t.i = m.det_idx THEN '[MASK]' ELSE t.word END, ' ' ORDER BY t.i) AS masked, m.noun
FROM om_all m JOIN otoks t USING (uid) GROUP BY m.uid, m.gold_det, m.noun""")
sql("flexible_use_counts", cte("cflex") + "SELECT * FROM cflex")
sql("set_subset", cte("otoks", "overall") + """
SELECT o.age_months, o.subject, p.noun FROM (
  SELECT d.uid, lower(d.word) AS det, lower(n.word) AS noun
  FROM otoks d JOIN otoks n ON n.uid = d.uid AND n.i IN (d.i + 1, d.i + 2) AND n.pos = 'NOUN'
  WHERE d.pos = 'DET') p JOIN overall o USING (uid)
GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE p.det = 'a') > 0 AND count(*) FILTER (WHERE p.det = 'the') > 0""")
sql("flexible_use_iqr", cte("ciqr") + "SELECT * FROM ciqr")
sql("trained_bands", cte("tb") + """
SELECT model_type, band_hi AS age, CAST(sum(strlen(utt) + 1) AS BIGINT) AS bytes
FROM tb WHERE model_type = 100 GROUP BY 1, 2""")
sql("skipped_ages", cte("om_all", "bands") + """
SELECT 100 AS model_type, CAST(trunc(age_months) AS INTEGER) AS age, count(*) AS n_sentences FROM om_all
WHERE CAST(trunc(age_months) AS INTEGER) NOT IN (SELECT band_hi FROM bands) GROUP BY 2""")
sql("model_availability", cte("om") + "SELECT uid, model_type, age FROM om")
sql("key_join_predictions", cte("ov_sc") + "SELECT uid, age_months, subject, pred_det, noun FROM ov_sc")
sql("pred_is_det", cte("ov_sc") + "SELECT uid, pred_det FROM ov_sc WHERE pred_det IN ('a', 'the')")
sql("replace_det", cte("mtoks") + "SELECT uid, string_agg(word, ' ' ORDER BY i) AS utt FROM mtoks GROUP BY uid")
sql("flexible_use_model", cte("mflex") + "SELECT * FROM mflex")
sql("union_ages", cte("miqr") + "SELECT * FROM miqr")
OVERALL_RES = """
SELECT c.age_months, c.median AS child_median, c.q1 AS child_q1, c.q3 AS child_q3,
       m.median AS model_median, m.q1 AS model_q1, m.q3 AS model_q3
FROM ciqr c LEFT JOIN miqr m USING (age_months)"""
sql("evaluate_overall", cte("ciqr", "miqr") + OVERALL_RES)
sql("ordered_age_groups", cte("ciqr", "miqr") + OVERALL_RES + " ORDER BY age_months")
sql("pred_gold_valid", cte("cmv") + "SELECT uid, gold_det, pred_det FROM cmv")
sql("confusion_matrix", cte("cmv") + """
SELECT g.gold, p.pred, coalesce(c.n, 0) AS n,
       round(CASE WHEN sum(coalesce(c.n, 0)) OVER () > 0
                  THEN CAST(coalesce(c.n, 0) AS DOUBLE) / sum(coalesce(c.n, 0)) OVER () ELSE 0.0 END, 9) AS share
FROM (VALUES ('a'), ('other'), ('the')) g(gold) CROSS JOIN (VALUES ('a'), ('other'), ('the')) p(pred)
LEFT JOIN (SELECT gold_det AS gold, pred_det AS pred, count(*) AS n FROM cmv GROUP BY 1, 2) c USING (gold, pred)""")
sql("accuracy_coverage", cte("cmv") + """
SELECT round(avg(CASE WHEN gold_det = pred_det THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
       round(avg(CASE WHEN pred_det IN ('a', 'the') THEN 1.0 ELSE 0.0 END), 9) AS coverage, count(*) AS n FROM cmv""")

# ------------------------------------------------------------ vocabulary, loss, charts
from detflow.operators.series import RESULT_CHARTS  # noqa: E402

register("tok_texts", ["normalized"], "SELECT uid, utt FROM normalized WHERE speaker = 'parent' AND trim(utt) <> ''")
register("vc", ["tok_texts"], """
  SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(utt, '[\\pL\\pN'']+')) AS w
  FROM tok_texts) GROUP BY 1""")
register("vr", ["vc"], """
  SELECT * FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM vc WHERE n >= 2)
  WHERE rank <= 30000""")
register("vocab", ["vr"], """
  SELECT * FROM (VALUES (0, '<s>', 0), (1, '[UNK]', 0), (2, '[PAD]', 0), (3, '[CLS]', 0), (4, '</s>', 0),
                        (5, '[MASK]', 0), (6, '[SEP]', 0)) s(id, word, n)
  UNION ALL SELECT CAST(rank + 6 AS INTEGER) AS id, word, n FROM vr""")
register("enc", ["tok_texts", "vocab"], """
  SELECT s.uid, list_concat(core, list_transform(range(64 - len(core)), lambda x: 2)) AS ids, len(core) AS n_real
  FROM (SELECT t.uid, list_concat([3], coalesce(e.ids, []), [6]) AS core FROM tok_texts t LEFT JOIN (
          SELECT uid, list(coalesce(v.id, 1) ORDER BY i) AS ids FROM (
            SELECT uid, unnest(x) AS w, generate_subscripts(x, 1) - 1 AS i
            FROM (SELECT uid, regexp_extract_all(utt, '[\\pL\\pN'']+') AS x FROM tok_texts))
          LEFT JOIN vocab v ON v.word = lower(w) WHERE i < 62 GROUP BY uid) e USING (uid)) s""")
sql("vocab_rank", cte("vr") + "SELECT CAST(rank AS INTEGER) AS rank, word, n FROM vr")
sql("build_vocab", cte("vocab") + "SELECT id, word, CAST(n AS BIGINT) AS n FROM vocab")
sql("encode_ids", cte("enc") + "SELECT uid, array_to_string(ids, ' ') AS input_ids, CAST(n_real AS INTEGER) AS n_real FROM enc")
_hm, _h2, _hr = H("uid", "i - 1", "'mlm'"), H("uid", "i - 1", "'mlm2'"), H("uid", "i - 1", "'rnd'")
_chosen = f"(i - 1 > 0 AND i - 1 < n_real - 1 AND {_hm} % 1000 < 150)"
sql("mlm_mask", cte("enc", "vocab") + f"""
SELECT uid,
  array_to_string(list_transform(ids, lambda x, i: CASE WHEN {_chosen} THEN
      CASE WHEN {_h2} % 10 < 8 THEN 5 WHEN {_h2} % 10 < 9 THEN {_hr} % vs ELSE x END
      ELSE x END), ' ') AS masked_ids,
  array_to_string(list_transform(ids, lambda x, i: CASE WHEN {_chosen} THEN x ELSE -100 END), ' ') AS labels
FROM enc CROSS JOIN (SELECT count(*) AS vs FROM vocab) v""")

register("cum", ["tri"], """
  SELECT p.model_type, p.band_hi,
         sum(p.n_tokens) OVER w AS n_tokens_cum, sum(coalesce(nw.n_new, 0)) OVER w AS vocab_cum
  FROM (SELECT model_type, band_hi, count(*) AS n_tokens FROM tri GROUP BY 1, 2) p
  LEFT JOIN (SELECT model_type, band_hi, count(*) AS n_new FROM (
               SELECT model_type, word, min(band_hi) AS band_hi FROM tri GROUP BY 1, 2) GROUP BY 1, 2) nw
    USING (model_type, band_hi)
  WINDOW w AS (PARTITION BY p.model_type ORDER BY p.band_hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
sql("cumulative_bands", cte("cum") + """
SELECT model_type, band_hi, CAST(n_tokens_cum AS BIGINT) AS n_tokens_cum, CAST(vocab_cum AS BIGINT) AS vocab_cum FROM cum""")
register("steps", ["tb"], """
  SELECT model_type, band_hi, rows, last_step,
         CAST(coalesce(sum(last_step + 1) OVER (PARTITION BY model_type ORDER BY band_hi
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
  FROM (SELECT model_type, band_hi, count(*) AS rows, CAST(ceil(count(*) / 64) * 3 AS BIGINT) AS last_step
        FROM tb GROUP BY 1, 2)""")
sql("step_offset", cte("steps") + "SELECT model_type, band_hi, rows, last_step, \"offset\" FROM steps")


def _running(by: list[str]) -> str:
    """Cumulative counts of ``by`` at every band in which it occurs."""
    cols = ", ".join(["model_type", "band_hi", *by])
    part = ", ".join(["model_type", *by])
    return (f"SELECT {cols}, sum(sum(n)) OVER (PARTITION BY {part} ORDER BY band_hi "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM tri_n GROUP BY {cols}")


register("tri_n", ["tri"], "SELECT model_type, band_hi, prev, next, word, count(*) AS n FROM tri GROUP BY ALL")
_ctx = [["prev", "next"], ["next"], ["prev"], []]
register("probs", ["tri_n"], "SELECT t.model_type, t.band_hi, t.n, " + ", ".join(
    f"CAST(a{i}.c AS DOUBLE) / b{i}.c AS p{i}" for i in range(1, 5)) + " FROM tri_n t " + " ".join(
    f"JOIN ({_running([*c, 'word'])}) a{i} USING ({', '.join(['model_type', 'band_hi', *c, 'word'])}) "
    f"JOIN ({_running(c)}) b{i} USING ({', '.join(['model_type', 'band_hi', *c])})" for i, c in enumerate(_ctx, 1)))
register("em0", [], "SELECT 0.25::DOUBLE AS l1, 0.25::DOUBLE AS l2, 0.25::DOUBLE AS l3, 0.25::DOUBLE AS l4")
_mix = "(l1 * p1 + l2 * p2 + l3 * p3 + l4 * p4)"
for _e in (1, 2, 3):
    register(f"em{_e}", ["probs", f"em{_e - 1}"], f"""
  SELECT model_type, band_hi, sum(n * -ln({_mix})) / sum(n) AS loss, """ + ", ".join(
        f"sum(n * l{i} * p{i} / {_mix}) / sum(n) AS l{i}" for i in range(1, 5)) + f"""
  FROM probs JOIN em{_e - 1} """ + ("ON true" if _e == 1 else "USING (model_type, band_hi)") + " GROUP BY model_type, band_hi")
register("bloss", ["em1", "em2", "em3"], " UNION ALL ".join(
    f"SELECT model_type, band_hi, {e} AS epoch, loss FROM em{e}" for e in (1, 2, 3)))
register("curve", ["steps", "bloss"], """
  SELECT s.model_type, s.band_hi, l.epoch, CAST(ceil(s.rows / 64) * l.epoch AS BIGINT) AS step,
         CAST(ceil(s.rows / 64) * l.epoch AS BIGINT) + s."offset" AS global_step, l.loss
  FROM steps s JOIN bloss l USING (model_type, band_hi)""")
sql("train_loss_curve", cte("curve") + """
SELECT model_type, band_hi, epoch, step, global_step, round(loss, 9) AS loss FROM curve""")
register("ctxc", ["qg", "tri"], """
  SELECT t.model_type, t.band_hi, 1 AS level, t.prev, t.next, t.word, count(*) AS n FROM tri t
  WHERE (t.model_type, t.prev, t.next) IN (SELECT model_type, prev, next FROM qg) GROUP BY 1, 2, 3, 4, 5, 6
  UNION ALL
  SELECT t.model_type, t.band_hi, 2, NULL, t.next, t.word, count(*) FROM tri t
  WHERE (t.model_type, t.next) IN (SELECT model_type, next FROM qg) GROUP BY 1, 2, 3, 4, 5, 6
  UNION ALL
  SELECT t.model_type, t.band_hi, 3, t.prev, NULL, t.word, count(*) FROM tri t
  WHERE (t.model_type, t.prev) IN (SELECT model_type, prev FROM qg) GROUP BY 1, 2, 3, 4, 5, 6
  UNION ALL
  SELECT model_type, band_hi, 4, NULL, NULL, word, count(*) FROM tri GROUP BY 1, 2, 3, 4, 5, 6""")
sql("context_counts", cte("ctxc") + "SELECT * FROM ctxc")

for _key, _chart_name in [("series_ratios", "ratios"), ("series_counts", "counts"), ("series_accuracy", "accuracy"),
                          ("series_prediction_ratio", "prediction_ratio"), ("series_across_models", "across_models")]:
    sql(_key, cte("res") + "\nUNION ALL\n".join(
        f"SELECT '{_chart_name}' AS chart, model_type, age, '{s}' AS series, CAST({e} AS DOUBLE) AS value FROM res"
        for s, e in RESULT_CHARTS[_chart_name]))
sql("series_mean_errorbar", cte("res") + """
SELECT 'mean_errorbar' AS chart, model_type, CAST(NULL AS INTEGER) AS age, 'mean' AS series,
       round(avg(total_misclassified), 9) AS value FROM res GROUP BY model_type
UNION ALL
SELECT 'mean_errorbar', model_type, NULL, 'std', round(stddev_samp(total_misclassified), 9) FROM res GROUP BY model_type""")
sql("series_flexible_use", cte("ciqr", "miqr") + f"""
SELECT 'flexible_use' AS chart, CAST(NULL AS INTEGER) AS model_type, CAST(age_months AS INTEGER) AS age, series, value
FROM ({OVERALL_RES}) r,
LATERAL (VALUES ('child_median', child_median), ('child_err_lower', child_median - child_q1),
                ('child_err_upper', child_q3 - child_median), ('model_median', model_median),
                ('model_err_lower', model_median - model_q1), ('model_err_upper', model_q3 - model_median),
                ('reference', CAST(2 AS DOUBLE))) v(series, value)""")
sql("series_loss", cte("curve") + """
SELECT 'loss' AS chart, model_type, CAST(band_hi AS BIGINT) AS band_hi, global_step AS step, 'loss' AS series, round(loss, 9) AS value
FROM curve""")

# ------------------------------------------------------------ streaming (equals the batch answer)
register("first_det", ["d2b"], """
  SELECT model_type, noun, min(CASE WHEN det = 'a' THEN band_hi END) AS a_from,
         min(CASE WHEN det = 'the' THEN band_hi END) AS the_from FROM d2b GROUP BY 1, 2""")
sql("incremental_bands", cte("first_det", "bands") + """
SELECT model_type, b.band_hi, count(*) AS total,
       count(*) FILTER (WHERE coalesce(a_from <= b.band_hi, false) AND NOT coalesce(the_from <= b.band_hi, false)) AS only_a,
       count(*) FILTER (WHERE NOT coalesce(a_from <= b.band_hi, false) AND coalesce(the_from <= b.band_hi, false)) AS only_the,
       count(*) FILTER (WHERE coalesce(a_from <= b.band_hi, false) AND coalesce(the_from <= b.band_hi, false)) AS both
FROM first_det f JOIN bands b ON least(coalesce(a_from, the_from), coalesce(the_from, a_from)) <= b.band_hi
GROUP BY 1, 2""")

# ------------------------------------------------------------ sources and sinks (round trips)
for _k in ("sink_age_bands", "src_band_text"):
    sql(_k, cte("tb") + "SELECT model_type, band_hi, utt FROM tb")
sql("src_loop_variants", cte("tb") + "SELECT model_type, band_hi, count(*) AS n_sentences FROM tb GROUP BY 1, 2")
for _k in ("sink_headerless", "src_headerless"):
    sql(_k, cte("sparent_u") + r"""
SELECT uid, utt, age_months, CAST(len(regexp_extract_all(utt, '[\pL\pN'']+')) AS INTEGER) AS n_tok FROM sparent_u""")
for _k in ("sink_maps", "src_noun_types"):
    sql(_k, cte("nt") + "SELECT model_type, noun, types FROM nt")
for _k in ("sink_test_sets", "discover_partitions"):
    sql(_k, cte("testset", "schild_u") + """
SELECT t.model_type, t.age, t.uid, u.utt FROM testset t JOIN schild_u u USING (uid)""")
sql("src_decimal_comma", cte("testset", "schild_u") + """
SELECT DISTINCT t.uid, u.age_months FROM testset t JOIN schild_u u USING (uid)""")
sql("sink_results", cte("res") + "SELECT * FROM res")
sql("sink_overall_set", cte("overall") + "SELECT uid, subject, age_months, utt FROM overall")
sql("run_metrics", cte("rw1_dec") + """
SELECT count(*) AS windows, count(*) FILTER (WHERE conflict) AS conflicts FROM rw1_dec""")
sql("preprocess_pipeline", cte("nt", "tb") + """
SELECT n.model_type, n.n_nouns, b.n_sentences
FROM (SELECT model_type, count(*) AS n_nouns FROM nt GROUP BY 1) n
JOIN (SELECT model_type, count(*) AS n_sentences FROM tb GROUP BY 1) b USING (model_type)""")
