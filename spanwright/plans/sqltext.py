"""DuckDB spellings of the text functions, for the oracles."""

from spanwright.functions.text import FOLD_FROM, FOLD_TO, TECHNICAL_TOKEN_FORMS, ZERO_WIDTH


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: RE2 class of Python's white space.
WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TECHNICAL_TOKEN = "(?:" + "|".join(TECHNICAL_TOKEN_FORMS).replace("{ws}", WS) + ")"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def normalize(text: str) -> str:
    return fold(f"nfc_normalize({text})")


def fold(text: str) -> str:
    t = f"translate({text}, {_literal(FOLD_FROM + ZERO_WIDTH)}, {_literal(FOLD_TO)})"
    t = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, ' {{2,}}', ' ', 'g')"
    t = f"regexp_replace({t}, '(?m) +$', '', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(t)


def canonical_sha256(column: str) -> str:
    bare = f"regexp_replace(lower(trim({column})), '^sha-?256:', '')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{64}}') THEN {bare} END"


def canonical_label(column: str) -> str:
    return f"regexp_replace(lower({strip(column)}), '[ -]+', '_', 'g')"
