"""Pieces of DuckDB SQL that say the same as the column functions, for checking them."""

from __future__ import annotations

from factmill import fixed

GUARD, SPLIT = "\ue000", "\ue001"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def words(s: str) -> str:
    return f"len(regexp_extract_all({s}, '\\S+'))"


def strip(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def markers(s: str) -> str:
    return strip(f"regexp_replace({s}, {lit(fixed.FOOTNOTE_MARKER)}, '', 'g')")


def editorial(s: str) -> str:
    return f"regexp_matches({s}, {lit(fixed.EDITORIAL)})"


def figure(s: str) -> str:
    return f"regexp_matches({markers(s)}, {lit(fixed.FIGURE_START)})"


def junk(s: str) -> str:
    return f"({editorial(s)} OR {figure(s)})"


def citation(s: str) -> str:
    return f"(regexp_matches({s}, {lit(fixed.FOOTNOTE_START)}) AND {words(s)} < {fixed.MIN_FOOTNOTE_WORDS})"


def quoted(s: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({s}, {lit(fixed.QUOTED)}), lambda q: length(q))), 0)"


def good(s: str) -> str:
    return f"({words(s)} BETWEEN 8 AND 60 AND NOT {junk(s)} AND {quoted(s)} <= 0.6 * length({s}))"


def keeps(s: str) -> str:
    return f"({words(s)} >= 6 AND NOT starts_with({s}, '[Illustration') AND NOT {editorial(s)} AND NOT {citation(s)})"


def refusal(s: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({s}, {lit('(?i)' + p)})" for p in fixed.REFUSALS) + ")"


def normalized(s: str) -> str:
    clean = f"regexp_replace(replace(lower(strip_accents({s})), '’', ''''), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"array_to_string(list_filter(regexp_extract_all({clean}, '\\S+'), lambda w: w NOT IN ('a', 'an', 'the')), ' ')"


def span(answer: str, reference: str) -> str:
    return f"({reference} <> '' AND contains(' ' || {answer} || ' ', ' ' || {reference} || ' '))"


def sentences(s: str) -> str:
    guarded = f"regexp_replace({s}, '\\b({'|'.join(fixed.ABBREVIATIONS)})\\.', '\\1{GUARD}', 'g')"
    marked = f"""regexp_replace({guarded}, '([.!?])["”’'')\\]]*\\s+(["“‘''(\\[]?[A-Z0-9])', '\\1{SPLIT}\\2', 'g')"""
    parts = f"list_transform(string_split({marked}, '{SPLIT}'), lambda x: {strip(f'''replace(x, '{GUARD}', '.')''')})"
    return f"list_filter({parts}, lambda x: x <> '')"


#: Kept paragraphs of folded documents and their sentences.
PARAS = f"""
lines AS (
  SELECT doc_id, lang, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS para
  FROM (SELECT doc_id, lang, string_split(strip_accents(text), chr(10)) AS ls FROM documents)
), paras AS (
  SELECT doc_id, lang, para, line, {sentences(markers('line'))} AS sents FROM lines WHERE line <> '' AND {keeps('line')}
), sentences AS (
  SELECT doc_id, lang, para, unnest(sents) AS sentence, generate_subscripts(sents, 1) - 1 AS sent FROM paras
)"""

_APOS = "'''’'"


def terms(name: str, source: str, keys: str, s: str) -> str:
    """CTEs that end in name(keys, s, term, ord): one row for each candidate term of a sentence, in order."""
    n = name
    return f"""
{n}_src AS (SELECT {keys}, {s} AS s FROM {source}),
{n}_n1 AS (SELECT *, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS i FROM (SELECT *, regexp_extract_all(s, {lit(fixed.PROPER_NOUN)}) AS ms FROM {n}_src)),
{n}_n2 AS (SELECT *, list_filter(regexp_split_to_array(trim(split_part(m, '--', 1), '''’-'), '\\s+'), lambda w: w <> '') AS w0 FROM {n}_n1),
{n}_n3 AS (SELECT *, w0[1:greatest(1, coalesce(list_max(list_transform(w0, lambda w, j: CASE WHEN upper(w) = w AND length(w) > 1 THEN 0 ELSE j END)), 1))] AS w1 FROM {n}_n2),
{n}_n4 AS (SELECT *, w1[coalesce(list_min(list_transform(w1, lambda w, j: CASE WHEN list_contains({strings(fixed.STOP_TERMS)}, lower(trim(w, {_APOS}))) THEN 1000000 ELSE j END)), 1):] AS w2 FROM {n}_n3),
{n}_n5 AS (SELECT *, array_to_string(w2, ' ') AS term FROM {n}_n4),
{n}_names AS (
  SELECT {keys}, s, term, i AS ord FROM {n}_n5
  WHERE length(term) >= 3 AND NOT list_contains({strings(fixed.STOP_TERMS)}, lower(term)) AND NOT (i = 0 AND len(w2) = 1 AND term = m AND starts_with(s, m))
    AND NOT regexp_matches(term, {lit(fixed.ROMAN_TERM)})
),
{n}_d1 AS (
  SELECT {keys}, s, unnest(ns) AS term, generate_subscripts(ns, 1) AS k, len(ns) AS n, ps
  FROM (SELECT *, regexp_extract_all(s, {lit(fixed.NUMBER)}) AS ns, string_split_regex(s, {lit(fixed.NUMBER)}) AS ps FROM {n}_src)
),
{n}_d2 AS (SELECT *, ltrim(ps[k + 1], ' ,') AS f FROM {n}_d1),
{n}_d3 AS (SELECT *, CASE WHEN k < n AND position(' ' IN f) = 0 THEN '' ELSE trim(lower(split_part(f, ' ', 1)), '.,;:)') END AS follows FROM {n}_d2),
{n}_numbers AS (
  SELECT {keys}, s, term, 100000 + k AS ord FROM {n}_d3
  WHERE regexp_full_match(term, '1[0-8][0-9][0-9]|1900') OR list_contains({strings(fixed.MEASURE_WORDS)}, follows)
),
{n} AS (
  SELECT {keys}, s, term, min(ord) AS ord FROM (SELECT * FROM {n}_names UNION ALL SELECT * FROM {n}_numbers)
  WHERE (length(s) - length(replace(s, term, ''))) / length(term) = 1 GROUP BY ALL
)"""


def chosen(name: str, terms_: str, freq: str, keys: str) -> str:
    """A CTE name(keys, key_term, freq): the rarest, then the longest, then the first candidate."""
    k = ", ".join(f"t.{c.strip()}" for c in keys.split(","))
    return f"""
{name} AS (
  SELECT {keys}, term AS key_term, freq FROM (
    SELECT {k}, t.term, CAST(coalesce(q.freq, 0) AS BIGINT) AS freq, row_number() OVER (PARTITION BY {k} ORDER BY coalesce(q.freq, 0), -length(t.term), t.ord) AS r
    FROM {terms_} t LEFT JOIN {freq} q ON q.term = t.term
  ) WHERE r = 1
)"""


SENTENCE_TERMS = PARAS + "," + terms("st", "sentences", "doc_id, para, sent", "sentence") + """,
freq AS (SELECT term, count(*) AS freq FROM st GROUP BY term)"""

_USABLE = f"{words('x')} >= 5 AND NOT {junk('x')} AND j - 1 <> sent"

#: Candidate facts of documents with their context.
CANDIDATES = SENTENCE_TERMS + f""",
edges AS (
  SELECT doc_id, para, sents, lag(sents[-1]) OVER w AS before_, lead(sents[1]) OVER w AS after_ FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY para)
), good AS (
  SELECT s.doc_id, s.para, s.sent, s.sentence AS fact, e.sents, e.before_, e.after_ FROM sentences s JOIN edges e USING (doc_id, para) WHERE {good('s.sentence')}
), c1 AS (
  SELECT *, list_filter(sents, lambda x, j: {_USABLE}) AS others FROM good
), c2 AS (
  SELECT *, list_filter(others, lambda x: regexp_matches(x, {lit(fixed.DEFINITION)}))[1] AS true_, CASE WHEN sent > 0 THEN sents[sent] ELSE before_ END AS prev_ FROM c1
), c3 AS (
  SELECT *, coalesce(true_, prev_) AS definition, coalesce(sents[sent + 2], after_) AS next_ FROM c2
), c4 AS (
  SELECT *, CASE WHEN next_ IS NOT DISTINCT FROM definition THEN list_filter(others, lambda x: x IS DISTINCT FROM definition AND x <> fact)[1] ELSE next_ END AS example FROM c3
), ctx AS (
  SELECT doc_id, para, sent, fact, definition, example, true_ IS NOT NULL AS true_definition FROM c4
  WHERE definition <> '' AND example <> '' AND fact <> definition AND fact <> example AND definition <> example
), gt AS (
  SELECT st.* FROM st JOIN good g USING (doc_id, para, sent)
),{chosen('keyed', 'gt', 'freq', 'doc_id, para, sent')},
cand AS (
  SELECT ctx.*, k.key_term, k.freq, 1.0::DOUBLE / (1 + k.freq) + CASE WHEN true_definition THEN 0.5 ELSE 0.0 END::DOUBLE AS score
  FROM ctx JOIN keyed k USING (doc_id, para, sent)
)"""


def capped(name: str, source: str, order: str, cap: int = 2, fact: str = "fact", term: str = "key_term") -> str:
    return f"""
{name}_1 AS (SELECT *, row_number() OVER (PARTITION BY {fact} ORDER BY {order}) AS r1 FROM {source}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {term} ORDER BY {order}) AS r2 FROM {name}_1 WHERE r1 = 1) WHERE r2 <= {cap})"""


def values(rows: list[tuple], columns: str) -> str:
    """An inline table."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]::VARCHAR[]"
        return lit(x) if isinstance(x, str) else repr(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({columns})"
