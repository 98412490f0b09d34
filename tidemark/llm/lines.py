"""Quality rules, line first: each line is judged alone, failing lines go, then documents that lost too much are rejected.

All of it is built-in expressions over one scan; nothing is shuffled and no text leaves the JVM. Defined results:

* a null, empty or blank text has no line to keep and is rejected;
* white space around a line goes (tabs, carriage returns and Unicode spaces too); blank lines are dropped and count neither as
  kept nor as lost;
* lines and documents may be of any length: a line of more than ``WINDOW`` words is judged in consecutive pieces of equal
  numbers of words, at most that many each, so that a phrase, marks or repeats cost it the piece that holds them and not
  the line; a phrase that the border of two pieces cuts is not seen. A word of over ``WORD_CHARS`` characters counts as
  several, so that texts without spaces are cut too. Whether it holds a sentence is asked of the whole line, and a line
  that repeats longer passages than a piece goes whole;
* repeated rows are judged alike, each for itself;
* an empty table gives an empty table; all other columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed

#: A line must hold a sentence: it ends like one (quotes and brackets may close it), or one ends within it.
ENDING = "[.!?;:…。！？][\"'”’»)\\]]*( |$)"
#: From so many words on, a line may do without.
PROSE_WORDS = 10
#: Words joined by bars, arrows or bullets: menus and bread crumbs, also flattened tables.
NAVIGATION = "[^ ] ?[|»›•·] ?[^ ].*[|»›•·]"
#: Stock phrases in four languages. They end at word boundaries; a line fails if they make up BOILERPLATE_SHARE of its characters.
_PHRASES = (
    "all rights reserved", "(privacy|cookie) (policy|notice|settings|preferences)", "terms (of|and) (use|service|conditions)", "(we|site|website|page) uses? cookies", "accept (all )?cookies",
    "(enable|requires|turn on) javascript", "lorem ipsum( dolor sit amet)?", "click here( to| for)?", "(subscribe|sign up) (to|for) (our|the|this)( newsletter)?", "log ?in to (your|continue|comment|reply|view)",
    "powered by [^ ]+", "share (this|on) (facebook|twitter|linkedin|page|post|article|story)", "copyright ([(]c[)] ?|© ?)?[0-9]{4}", "© ?[0-9]{4}",
    "(licensed|released|distributed|available) under [^.]{0,40}(licen[cs]e|cc by|cc0|gnu|mit|apache|bsd|mpl)",
    "alle rechte vorbehalten", "datenschutz(erklärung|bestimmungen|hinweise)", "nutzungsbedingungen", "(wir|seite|website) verwende[nt] cookies", "cookies? (akzeptieren|zulassen|einstellungen)", "hier klicken",
    "newsletter (abonnieren|anmelden)", "(lizenziert|veröffentlicht) unter [^.]{0,40}(lizenz|cc by|gnu|mit|apache)",
    "tous droits réservés", "politique de (confidentialité|cookies)", "mentions légales", "conditions (générales )?d.utilisation", "(nous utilisons|site utilise) des cookies", "accepter (tous )?les cookies", "cliquez ici",
    "(abonnez|inscrivez)-vous à", "(distribué|publié|disponible) sous [^.]{0,40}(licence|cc by|gnu|mit|apache)",
    "todos los derechos reservados", "política de (privacidad|cookies)", "aviso legal", "(términos|condiciones) de uso", "(utilizamos|usa|utiliza) cookies", "aceptar (todas )?(las )?cookies", "ha(ga|z) clic aquí",
    "(suscríbase|suscríbete) a", "(licenciado|publicado|distribuido) bajo [^.]{0,40}(licencia|cc by|gnu|mit|apache)",
)
BOILERPLATE = "(^|[^\\p{L}\\p{N}])(" + re.sub(r"(?<!\[)\(", "(?:", "|".join(_PHRASES)) + ")($|[^\\p{L}\\p{N}])"
BOILERPLATE_SHARE = 0.3
#: White space besides the space: tab, vertical tab, form feed, carriage return, no-break and ideographic space, zero-width space, byte order mark.
SPACES = (9, 11, 12, 13, 160, 12288, 8203, 65279)
#: Marks glued to a word two or more times in a line: emphasis spam and broken markup.
SYMBOLS = "([$%#&*!?^~=_+]{2,}.*){2,}"
#: A line of at least so many words of which fewer than this share are different repeats itself.
REPEAT_WORDS, REPEAT_SHARE = 12, 0.25
#: A longer line is judged in pieces, of which each has over half as many words.
WINDOW, WORD_CHARS = 256, 64
#: Of a longer line, the share of different runs of so many words is held against REPEAT_SHARE too; unlike that of words, it does not fall with length.
RUN_WORDS = 10
#: A document must keep this share of its characters.
KEEP_SHARE = 0.5


def _prose(lower: str, words: str, size: str, matches: str, quote: tuple[str, str]) -> str:
    """Whether a line holds a sentence, or words enough to do without."""
    return f"({matches.format(x=lower, p=ENDING.replace(*quote))} OR {size}({words}) >= {PROSE_WORDS})"


def _rules(lower: str, words: str, distinct: str, size: str, matches: str, quote: tuple[str, str], replace: str, prose: str | None = None) -> str:
    """The rules over one trimmed line as SQL: its lower-case form, its words, and the dialect's names for functions."""
    rule = lambda pattern: matches.format(x=lower, p=pattern.replace(*quote))
    phrases = f"length({lower}) - length({replace.format(x=lower, p=BOILERPLATE.replace(*quote))}) >= {BOILERPLATE_SHARE} * length({lower})"
    return (
        f"{prose or _prose(lower, words, size, matches, quote)} AND NOT {rule(NAVIGATION)} AND NOT {rule(SYMBOLS)} AND NOT ({rule(BOILERPLATE)} AND {phrases})"
        f" AND ({size}({words}) < {REPEAT_WORDS} OR {size}({distinct}({words})) >= {REPEAT_SHARE} * {size}({words}))"
    )


def _trim(line: str) -> str:
    return "trim(BOTH ' " + "".join(f"\\u{c:04X}" for c in SPACES) + f"' FROM {line})"


def _pieces(line: str) -> str:
    """The pieces of a trimmed line as SQL: their concatenation is the line; none if the line repeats itself from piece to piece."""
    count = f"((size(u) + {WINDOW - 1}) div {WINDOW})"
    start = lambda k: f"int({k} * bigint(size(u)) div {count})"
    cut = f"transform(sequence(0, int({count}) - 1), k -> array_join(slice(u, {start('k')} + 1, {start('(k + 1)')} - {start('k')}), ''))"
    runs = f"transform(sequence(1, size(u) - {RUN_WORDS - 1}), k -> xxhash64(slice(u, k, {RUN_WORDS})))"
    repeats = f"exists(array({runs}), r -> size(array_distinct(r)) < {REPEAT_SHARE} * size(r))"
    units = f"regexp_extract_all({line}, '([^ ]{{1,{WORD_CHARS}}} *)', 1)"
    # More words than a window take more than twice as many characters.
    return f"if(length({line}) <= {2 * WINDOW}, array({line}), flatten(transform(array({units}), u -> if(size(u) <= {WINDOW}, array({line}), if({repeats}, cast(array() AS array<string>), {cut})))))"


def clean_lines(docs: DataFrame, text: str = "text", length: str = "n_chars", keep_share: float = KEEP_SHARE) -> DataFrame:
    """Documents that keep enough, with their kept lines as text and, where the column exists, their new length."""
    dialect = ("size", "{x} rlike r\"{p}\"", ('"', "\\x22"))
    passes = _rules("p.lower", "p.words", "array_distinct", *dialect, "regexp_replace({x}, r\"{p}\", '')", prose="s.prose")
    lines = f"filter(transform(split(row.`{text}`, '\\n'), l -> {_trim('l')}), l -> l <> '')"
    pieces = f"transform({_pieces('l')}, p -> named_struct('piece', p, 'lower', lower({_trim('p')}), 'words', split({_trim('p')}, ' ')))"
    # Each struct is made once: the next lambda takes it as its variable, so no rule is evaluated twice.
    read = f"transform({lines}, l -> named_struct('length', length(l), 'prose', {_prose('l', "split(l, ' ')", *dialect)}, 'pieces', {pieces}))"
    line = _trim(f"array_join(filter(s.pieces, p -> {passes}).piece, '')")
    kept = f"transform(array({read}), a -> named_struct('all', a.length, 'kept', filter(transform(a, s -> {line}), l -> l <> '')))"
    joined = f"transform({kept}, s -> named_struct('text', array_join(s.kept, '\\n'), 'kept', aggregate(s.kept, 0L, (n, l) -> n + length(l)), 'all', aggregate(s.all, 0L, (n, l) -> n + l)))"
    good = f"filter({joined}, s -> s.kept > 0 AND s.kept >= {keep_share} * s.all)"
    rows = packed(docs).select("row", F.expr(f"explode({good})").alias("clean"))
    new = {text: F.col("clean.text"), length: F.length("clean.text").cast(dict(docs.dtypes).get(length, "bigint"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def oracle() -> str:
    passes = _rules("lower(l)", "string_split(l, ' ')", "list_distinct", "len", "regexp_matches({x}, '{p}')", ("'", "''"), "regexp_replace({x}, '{p}', '', 'g')")
    spaces = "' ' || " + " || ".join(f"chr({c})" for c in SPACES)
    return f"""
WITH a AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, {spaces})), lambda l: l <> '') AS ls FROM documents),
 b AS (SELECT *, list_filter(ls, lambda l: {passes}) AS ks FROM a),
 c AS (SELECT *, length(array_to_string(ls, '')) AS n_all, length(array_to_string(ks, '')) AS n_kept, array_to_string(ks, chr(10)) AS t FROM b)
SELECT doc_id, t AS text, lang, source, length(t) AS n_chars FROM c WHERE n_kept > 0 AND n_kept >= {KEEP_SHARE} * n_all
"""
