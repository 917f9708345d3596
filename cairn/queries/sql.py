"""Pieces of the comparison SQL (DuckDB dialect): the text kernel restated independently as SQL expressions."""

DIG = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"


def fold(x: str) -> str:
    return f"lower(translate({x}, 'İıßſς', 'iissσ'))"


def prepared(x: str) -> str:
    split = rf"regexp_replace(regexp_replace({x}, '(\p{{L}})([{DIG}])', '\1 \2', 'g'), '([{DIG}])(\p{{L}})', '\1 \2', 'g')"
    return split


def plain(x: str) -> str:
    return rf"regexp_replace(nfc_normalize({x}), '\p{{M}}+', '', 'g')"


def tokens(x: str) -> str:
    return rf"list_transform(regexp_extract_all({prepared(plain(x))}, '[\p{{L}}\p{{N}}]+'), lambda t: {fold('t')})"


def number(x: str) -> str:
    return f"regexp_matches({x}, '^[{DIG}]+$')"


def content(t: str) -> str:
    """Words of a token list column, by index."""
    near = lambda i: f"coalesce({number(f't{i}')}, false)"
    keep = (
        f"length({t}[i]) >= 3 OR {number(f'{t}[i]')} OR coalesce({number(f'{t}[i-1]')}, false) AND i > 1 OR coalesce({number(f'{t}[i+1]')}, false)"
    )
    return f"list_transform(list_filter(range(1, len({t}) + 1), lambda i: {keep}), lambda i: {t}[i])"


def words(x: str) -> str:
    """Words of a text expression; the tokens are made once by a lateral list."""
    return f"(SELECT {content('k.t')} FROM (SELECT {tokens(x)} AS t) k)"


def stem(a: str, b: str, root: int = 5) -> str:
    n = f"greatest({root}, greatest(length({a}), length({b})) - 3)"
    return f"({a} = {b} OR left({a}, {n}) = left({b}, {n}))"


def sentences(marks: str = ".!?;") -> str:
    """CTEs up to ``s`` (doc_id, source, pos, sentence) over documents."""
    return rf"""
d AS (SELECT doc_id, coalesce(source, '#doc:' || doc_id) AS source,
       string_split_regex(regexp_replace(nfc_normalize(text), '([{marks}])[\s\x0B]+', '\1' || chr(10), 'g'), '\n+') AS parts FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, source, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '') AS parts FROM d),
s AS (SELECT doc_id, source, unnest(range(len(parts))) AS pos, unnest(parts) AS sentence FROM e)"""


STORE = sentences() + f""",
t AS (SELECT doc_id || ':' || pos AS sid, source, sentence, {tokens('sentence')} AS t FROM s),
w AS (SELECT sid, source, sentence, {content('t')} AS words FROM t),
post AS (SELECT sid, source, unnest(list_distinct(words)) AS word FROM w)"""

RECORDS = """
r AS (SELECT DISTINCT record_key, subject, predicate, lower(trim(value_text)) AS value, source, level, trust, witnesses,
       stated_at AS told, last_seen, episodic, unit FROM dynamics
      WHERE subject IS NOT NULL AND predicate IS NOT NULL AND value_text IS NOT NULL),
g AS (SELECT * FROM r WHERE trust BETWEEN 0 AND 1 AND NOT isnan(trust))"""
