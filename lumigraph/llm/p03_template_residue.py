"""Problem 3: fields holding template residue, filler, error-page messages or notices that scripts are needed.

Each delimiter has its own grammar: an opening sign, an identifier, the matching closing sign (or the end of a field
that was cut short). Escaped signs are read as signs. Single braces, percent and dollar signs also occur in sound
texts, so there the inside must be a name of at least three letters and nothing else; numbers, lists and spaces are
content. Bare values (null, undefined, NaN) and numbered slots count only where they fill the field; error numbers
only beside a status phrase. Messages are known in any case of their letters and without accents, and cut short: as the
beginning of a known message, alone, behind a separator or before an ellipsis.

One rule of context and density holds for texts of any length. Code blocks and signs in backquotes, signs within a
short distance of words about templates ("syntax", "tutorial", "snippet") and messages in quotes beside a word that
tells of them ("reads", "sign", "screenshot") are mentions and are taken out first. What is left must hold residue
that takes up at least DENSITY of the whole text: a placeholder or message alone does so in any caption, a phrase met
once in an article does not. All tests are regular expressions inside the JVM, so the operator is a single pass without
a shuffle.

Defined results: null and blank fields are no cases; every row is judged by itself, so repeated rows give repeated
results; an empty table gives an empty result; further columns are ignored; whole texts are read.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from re import _constants as _sre
from re import _parser as _sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.session import table

#: Letters with accents by their bare letters, as messages in capitals often lack the accents; combining accents go.
_BARE = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xE0, 0x180), *range(0x386, 0x460), *range(0x1E00, 0x2000)]) if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1} | {"ς": "σ", "ſ": "s", "ı": "i", "’": "'"}
_ACCENTS = "".join(map(chr, range(0x300, 0x370)))


def bare(text: str) -> str:
    """A text (or pattern) in lower case without accents."""
    return text.translate(str.maketrans("".join(_BARE), "".join(_BARE.values()), _ACCENTS))


def bare_column(c: Column) -> Column:
    lower = F.lower(c)
    return F.when(lower.rlike(r"[^\x00-\x7F]"), F.translate(lower, "".join(_BARE) + _ACCENTS, "".join(_BARE.values()))).otherwise(lower)


def _pieces(nodes) -> frozenset[str] | None:
    """Pieces of text (in lower case) one of which every match of a parsed pattern holds; null where none is certain."""
    found, run = [], ""
    for op, arg in [*nodes, (None, None)]:
        if op is _sre.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            found.append(frozenset([run]))
        run = ""
        if op is _sre.SUBPATTERN:
            found.append(_pieces(arg[3]))
        elif op is _sre.BRANCH:
            parts = [_pieces(b) for b in arg[1]]
            found.append(None if None in parts else frozenset().union(*parts))
        elif op is _sre.MAX_REPEAT and arg[0] >= 1:
            found.append(_pieces(arg[2]))
        elif op is _sre.IN and all(o is _sre.LITERAL for o, _ in arg):
            found.append(frozenset(chr(c).lower() for _, c in arg))
    return max((f for f in found if f), key=lambda f: (min(map(len, f)), -len(f)), default=None)


def triggers(patterns: list[str]) -> list[str] | None:
    """Pieces of text one of which every case of the patterns holds; null where a pattern has none."""
    found = [_pieces(_sre_parser.parse(re.sub(r"\\p\{\w+\}", r"\\w", p).replace("(?iu)", "").replace("(?i)", ""))) for p in patterns]
    if None in found:
        return None
    every = frozenset().union(*found)
    return sorted(t for t in every if not any(u != t and u in t for u in every))


#: The inside of a placeholder: a name, and what may follow it (a filter, a default); a longer name between single signs.
NAME = r"[$@]?[\p{L}_][\p{L}\p{M}\p{N}_.:\-]*(?:\s*[|(?][^{}<>\[\]]{0,40}?)?"
LONG_NAME = r"[a-z_][a-z0-9_.:\-]{2,}"
FILTER = r"(?:\s*\|{1,2}\s*[^{}%$]{1,30})?"
#: Opening and closing signs of template languages (patterns).
DELIMITERS = [
    (r"\{\{\{?", r"\}\}\}?"),
    (r"\{%-?", r"-?%\}"),
    (r"[$#]\{", r"\}"),
    (r"<%[=\-]?", r"%>"),
    (r"<\?(?:=|php\b)", r"\?>"),
    (r"<!--", r"-->"),
    (r"\[\[", r"\]\]"),
    (r"\[%", r"%\]"),
    (r"\*\|", r"\|\*"),
    (r"@@", r"@@"),
    (r"##", r"##"),
    (r"%%", r"%%"),
    (r"(?<![\p{L}\p{N}_])__", r"__(?![\p{L}\p{N}_])"),
]
_GRAMMARS = [rf"{o}\s*{NAME}\s*(?:{c}|…|\.\.\.)" for o, c in DELIMITERS]
#: Between double signs anything short with a letter: keywords, calls, indexes.
_GRAMMARS += [
    r"\{\{[^{}]{0,80}?\p{L}[^{}]{0,80}?\}\}", r"\{%[^{}%]{0,80}?\p{L}[^{}%]{0,80}?%\}", r"\$\{[^{}]{0,80}?\p{L}[^{}]{0,80}?\}",
    r"<%.{0,80}?\p{L}.{0,80}?%>", r"<\?(?:=|php\b).{0,80}?\p{L}.{0,80}?\?>",
]
#: A field cut short behind an opening sign.
_CUT = [rf"(?:{o})\s*[$@]?[\p{{L}}_][\p{{L}}\p{{M}}\p{{N}}_.:|\-]*\s*$" for o, _ in DELIMITERS[:9]]
_CUT += [r"(?:\{\{|\{%|<%|<\?(?:=|php\b))[^{}<>%]{0,80}?\p{L}[^{}<>%]{0,80}[}%?]?\s*$"]
_SINGLE = [rf"\{{{LONG_NAME}{FILTER}\}}", rf"(?<![\p{{L}}\p{{N}}])%{LONG_NAME}{FILTER}%(?![\p{{L}}\p{{N}}])", rf"(?<![\p{{L}}\p{{N}}])\${LONG_NAME}{FILTER}\$(?![\p{{L}}\p{{N}}])"]
_SLOTS = [r"(?<![\p{L}\p{N}%])%(?:\d+\$)?s(?![\p{L}\p{N}])", r"^[\s\p{P}\p{S}]*\{\d+\}(?:[\s\p{P}\p{S}]*\{\d+\})*[\s\p{P}\p{S}]*$"]
PLACEHOLDER = "(?iu)" + "|".join([*_GRAMMARS, *_CUT, *_SINGLE, *_SLOTS])

#: Signs that a text talks about: in code blocks or backquotes, behind a word for them or before one; in quotes where the text is about templates; near words about templates.
_SIGN = "(?:" + "|".join([*_GRAMMARS, *_SINGLE, *_SLOTS[:1]]) + ")"
_ABOUT = r"(?:syntax|templating|tutorial|placeholders?|template (?:tags?|syntax|languages?|variables?|engines?))"
_NEAR = r"\b(?:syntax|templating|tutorial|example code|code example|snippet|curly braces?|placeholder called|variable named)\b"
_GAP = r"[^.!?,;\n]{0,60}"
MENTIONED = "(?iu)" + "|".join([
    r"(?s)```.*?```|(?s)<(code|pre)\b[^>]*>.*?</\1>", r"`[^`]*`", rf"(?<={_NEAR}{_GAP}){_SIGN}", rf"{_SIGN}(?={_GAP}{_NEAR})",
    rf"\b(?:(?:how to|to) (?:use|write|escape)|(?:placeholder|variable|tag|expression|string|template)s?(?: (?:called|named|like))?|such as|syntax)[\s:]+[\"'“‘«]?{_SIGN}",
    rf"{_SIGN}[\"'”’»]?\s+(?:{_ABOUT}\b|(?:in|inside|within|from|for|of)\s+(?:(?:an?|the|your|our)\s+)?(?:\p{{L}}+\s+)?(?:templates?\b|{_ABOUT}\b))",
    rf"(?<=\b{_ABOUT}\b.{{0,200}})[\"'“‘«]{_SIGN}[\"'”’»]|[\"'“‘«]{_SIGN}[\"'”’»](?=.*\b{_ABOUT}\b)",
])
#: Messages and filler that a text talks about (in bare form): in quotes beside a word that tells of them.
_TOLD = r"(?:reads?|reading|says|said|saying|shows?|showing|displays?|displaying|called|titled|entitled|labell?ed|marked|the (?:words?|phrase|message|text|notice|error)|sign|poster|screenshot of|screen of)"
QUOTED = rf"\b{_TOLD}\b[^\"“”«».!?\n]{{0,30}}[\"“«„][^\"”»“\n]{{1,160}}[\"”»“]|[\"“«„][^\"”»“\n]{{1,160}}[\"”»“]\s+(?:message|error|page|sign|screen|notice|text|button|label|poster)s?\b|(?s)```.*?```|`[^`]*`"

#: What programs print for missing values and keys.
_VALUE = r"(?:null|undefined|nan|none)"
VALUES = "(?iu)" + "|".join([
    rf"^[\s\p{{P}}\p{{S}}]*{_VALUE}(?:[\s\p{{P}}\p{{S}}]+{_VALUE})*[\s\p{{P}}\p{{S}}]*$",
    rf"^\p{{L}}+\s?:\s*{_VALUE}[\s.!]*$",
    rf"\b(?:of|by|de|von|image|photo)\s+{_VALUE}[\s.!]*$",
    r"\(null\)", r"<no value>", r"\[object \p{L}+\]?", r"#(?:name\?|ref!|value!|div/0!|n/a|null!|num!)",
    r"translation[ _]missing|missing[ _]translation|\bi18n[:.][a-z]",
    r"^\s*(?!www\.)[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*){2,}(?<!\.(?:jpg|jpeg|png|gif|webp|tif|tiff|svg|bmp|example|test|com|org|net))[\s.!…]*$",
])

#: The words of the common Latin filler text.
_LATIN = (
    r"(?:lorem|ipsum|dolore?|sit|amet|consec\p{L}*|adipisc\p{L}*|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqu(?:a|ip)|enim|minim|veniam|quis"
    r"|nostr(?:ud|um)|ullam\p{L}*|laboris|nisi|commodo|duis|aute|irure|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|mollit|anim|laborum)"
)
#: Filler texts and notes to the editor, by language.
REPEATED = r"(?iu)^[\s\p{P}]*(?:(\p{L})\1{2,}[\s\p{P}]+)+(?:\p{L}{1,4}[\s\p{P}]*)?$"
FILLER = "(?iu)" + bare("|".join([
    r"\blorem\s+(?:ipsum|ip?s?u?$)|^\s*lorem[\s.…]*$", rf"\b(?:{_LATIN}\b[\s\p{{P}}]*){{3}}", rf"^\s*(?:{_LATIN}\b[\s\p{{P}}]*){{2,}}\p{{L}}{{0,5}}[\s\p{{P}}]*$",
    r"\b(?:blah[\s,]+){1,}bla", r"^\s*(?:test[\s\p{P}]+)+(?:test|\d+)?[\s\p{P}]*$", r"\b(?:asdf|qwerty|qwer|foobar)\b", r"\bsample text\b", r"\bplaceholder text\b",
    r"^\s*(?:edit|put|type|insert|write|add|enter|place|your)\s+(?:(?:an?|the|your)\s+)?(?:(?:image|photo|picture|figure)\s+)?(?:caption|description|alt text|alternative text|headline|title|name of the)\b",
    r"\b(?:caption|description|alt text|headline|title|artwork|text|image|photo)\b.{0,30}(?:goes here|\bin this box|\(placeholder\)|[-–] sample only)",
    r"\bcaption tk\b|\bdo not publish\b|\btktk\b",
    r"\b(?:escriba|escribe|introduzca|inserte) aqu[íi]\b|\btexto de (?:ejemplo|exemplo|muestra)\b|\bpie de foto de muestra\b",
    r"\b(?:escriviu|escriu|introdu[ïi]u) aqu[íi]\b|\btext (?:de mostra|d.exemple)\b",
    r"\b(?:escreva|insira|digite) aqui\b|\blegenda de exemplo\b",
    r"\b(?:saisissez|saisir|ins[ée]rez|ins[ée]rer|[ée]crivez|[ée]crire|entrez|tapez|ajoutez)\b.{0,30}\b(?:l[ée]gende|description|titre|texte)\b.{0,12}\bici\b|\btexte d.exemple\b",
    r"\bbeispieltext\b|\bhier\b.{0,40}\beingeben\b|\bplatzhaltertext\b|\bbitte ersetzen\b",
    r"введите (?:описание|подпись|текст)|пример текста|образец текста|εισαγ[άα]γετε|κείμενο (?:παραδείγματος|δείγμα)|ここに.{0,20}(?:入力|記入)|サンプルテキスト|ダミーテキスト",
]))

#: Status phrases and error messages, by language.
_STATUS = (
    r"(?:not found|bad (?:gateway|request)|gone|forbidden|unauthori[sz]ed|payment required|method not allowed|not acceptable|conflict|too many requests"
    r"|request time-?out|gateway time-?out|service (?:temporarily )?unavailable|internal (?:server )?error|not implemented|unavailable)"
)
#: By language what may be missing, and what is said of it (patterns); a message is one beside the other, to the end of a clause.
FAILURES = {
    "en": (r"(?:page|file|image|picture|photo|resource|document|content|address|url|link|media)", r"(?:not found|(?:is |currently |temporarily )*(?:unavailable|not available)|(?:could|can) ?not be (?:loaded|displayed|found|shown|opened)|failed to (?:load|render|open)|(?:does not|doesn't|no longer) exists?|has been (?:removed|deleted))"),
    "es": (r"(?:p[áa]gina|archivo|imagen|foto|recurso|documento|contenido)", r"(?:no (?:encontrad[oa]|disponible|existe)|no se (?:ha podido|pudo|puede) (?:cargar|mostrar|encontrar))"),
    "pt": (r"(?:p[áa]gina|arquivo|ficheiro|imagem|foto|recurso|documento|conte[úu]do)", r"(?:n[ãa]o (?:encontrad[oa]|dispon[íi]vel|existe)|n[ãa]o p[ôo]de ser (?:carregad|exibid)[oa])"),
    "ca": (r"(?:p[àa]gina|fitxer|imatge|foto|recurs|document|contingut)", r"(?:no (?:trobad[oa]?|disponible|existeix)|no s.ha pogut (?:carregar|mostrar|trobar))"),
    "fr": (r"(?:page|fichier|image|photo|ressource|document|contenu)", r"(?:introuvable|indisponible|non trouv[ée]e?|n.existe (?:pas|plus)|n.a pas pu [êe]tre (?:charg|affich)[ée]e?)"),
    "de": (r"(?:seite|datei|bild|foto|inhalt|dokument|ressource)", r"(?:(?:wurde )?nicht (?:gefunden|verf[üu]gbar|vorhanden)|konnte nicht (?:geladen|angezeigt|gefunden) werden|existiert nicht(?: mehr)?)"),
    "ru": (r"(?:страница|файл|изображение|фото|документ)", r"(?:не (?:найден[аоы]?|существует|доступн[аоы]?)|недоступн[аоы]?|не удалось загрузить)"),
    "el": (r"(?:σελίδα|αρχείο|εικόνα|έγγραφο)", r"(?:δεν (?:βρέθηκε|υπάρχει|είναι διαθέσιμη?ο?))"),
    "ja": (r"(?:ページ|ファイル|画像|写真)", r"(?:が|は)?(?:見つかりません|存在しません|表示できません|読み込めません|利用できません)"),
}
_CLAUSE_END = r"(?=\s*(?:$|[.,;:!?…|–—\-。！]))"

ERRORS = "(?iu)" + bare("|".join([
    *(rf"(?<![\p{{L}}\p{{N}}]){what}\s*{said}{_CLAUSE_END}" for what, said in FAILURES.values()),
    rf"\b[45]\d\d\b[\s\p{{P}}\p{{S}}]*{_STATUS}\b", rf"\b{_STATUS}[\s\p{{P}}\p{{S}}]*\(?[45]\d\d\b",
    rf"\b(?:http|status(?: code)?|error(?: code)?)[\s:#]*[45]\d\d[\s\p{{P}}\p{{S}}]*(?:$|{_STATUS})", r"\bHTTP [45]\d\d\b",
    r"\b(?:page|file|image|resource) not found\b(?=\s*(?:$|[.!…|:–\-]))", r"\brequested (?:address|page|url|resource|file)\b.{0,20}\b(?:not|could)\b", r"\bpage you (?:are looking for|requested)\b",
    r"\bsession (?:has )?(?:expired|timed out)\b", r"\bplease (?:sign|log) in again\b", r"\baccess denied\b\s*[:.!]?\s*(?:you\b|$)", r"\byou do not have permission\b", r"\bnot available in your (?:region|country)\b",
    r"\bfatal error\b", r"\bout of memory\b", r"\b(?:warning|notice|error)\s?:\s*undefined\b", r"\bundefined (?:variable|index|offset|property)\b", r"\b\p{L}*(?:reference|type|syntax|range)error\b(?: at|:|\b)", r"\bexception\b.{0,20}\b(?:line|at)\b",
    r"\bsomething went wrong\b", r"\bcould not connect to\b", r"\bcould not be loaded\b", r"\bfailed to (?:render|load|fetch)\b", r"\btimed out after \d+", r"\bplease try again later\b", r"\btemporarily down\b",
    r"\brequest (?:was )?blocked\b|\bblocked\. .{0,20}(?:no\.|id)", r"\bchecking your browser\b", r"\bverify (?:that )?you are (?:a )?human\b",
    r"\bp[áa]gina no encontrada\b|\b(?:acceso denegado|error interno del servidor)\b|\bint[ée]ntelo (?:de nuevo )?m[áa]s tarde\b|\bvuelva a intentarlo\b|\bha ocurrido un error\b|\bla sesi[óo]n ha (?:caducado|expirado)\b",
    r"\bp[áa]gina n[ãa]o encontrada\b|\bacesso negado\b|\berro interno\b|\btente novamente\b|\bocorreu um erro\b",
    r"\bp[àa]gina no trobada\b|\bs.ha produ[ïi]t un error\b|\bacc[ée]s denegat\b|\berror intern\b",
    r"\bpage introuvable\b|\bacc[èe]s refus[ée]\b|\bla session a expir[ée]\b|\berreur (?:interne|\d{3})\b|\bune erreur (?:est survenue|s.est produite)\b|\br[ée]essayer plus tard\b",
    r"\bseite nicht gefunden\b|\bzugriff verweigert\b|\bfehler \d{3}\b|\bsp[äa]ter (?:erneut|noch einmal) versuchen\b|\binterner serverfehler\b|\bsitzung (?:ist )?abgelaufen\b",
    r"страница не найдена|доступ (?:запрещ[её]н|закрыт)|внутренняя ошибка|ошибка \d{3}|η σελίδα δεν (?:βρέθηκε|υπάρχει)|δεν επιτρέπεται η πρόσβαση|σφάλμα \d{3}|εσωτερικό σφάλμα|ページが見つかりません|アクセス(?:が)?拒否|エラーが発生|内部サーバー",
]))

#: Notices that scripts are needed, by language.
_SCRIPT = r"(?:java[\s\-]?script|\bjs\b|\bscripts\b|\bscripting\b|\bscript support\b)"
SCRIPTS = "(?iu)" + bare("|".join([
    rf"\b(?:enable|activate|allow|turn on|switch on|unblock)\s+{_SCRIPT}", rf"\b(?:requires?|needs?)\s+{_SCRIPT}", rf"\bturn\s+{_SCRIPT}\s+on\b",
    rf"{_SCRIPT}\s+(?:is|are|must be|has to be|have to be|needs? to be|was|were|seems?(?: to be)?)\s+(?:currently\s+)?(?:disabled|turned off|switched off|blocked|enabled|allowed|activated|turned on|switched on|required|needed|off)\b",
    r"\bthis (?:site|page|gallery|app|slideshow|website|content)\s+(?:doesn.t|does not|won.t|will not) work\b", r"\byou need to (?:enable|activate|allow|turn on) ",
    r"\b(?:active|activar|activa|habilite|habilitar|habilita)\s+(?:el\s+|los\s+)?(?:javascript|java script|scripts)\b|\bscripts (?:desactivados|deshabilitados)\b|\bnecesario habilitar\b",
    r"\b(?:ative|ativar|habilite)\s+(?:o\s+|os\s+)?(?:javascript|java script|scripts)\b|\bscripts (?:ativados|desativados)\b|\bcal activar\b|\bactiveu\b.{0,6}javascript",
    r"\bactiver (?:le )?(?:javascript|java script|les scripts|scripts)\b|\bne fonctionne pas sans\b|\bactivez (?:le )?javascript\b",
    r"\bjavascript (?:aktivieren|einschalten|erlauben)\b|\bskripte (?:aktivieren|erlauben|einschalten)\b|\baktivierte skripte\b|\bbitte javascript\b",
    r"включите javascript|javascript (?:отключен|отключён|выключен)|(?:требуется|необходим) javascript|ενεργοποιήστε (?:την |το )?javascript|javascript\s?を有効|スクリプトを有効|javascript\s?が(?:無効|必要)",
]))

#: For each kind of residue pieces of text one of which every case holds, taken from the patterns. They are looked for first, as a
#: search for fixed pieces costs a small part of a search for the patterns.
TRIGGERS = {kind: triggers([p]) for kind, p in (("placeholder", PLACEHOLDER), ("value", VALUES), ("filler", FILLER), ("error", ERRORS), ("scripts", SCRIPTS))}


def _may_be(kind: str, lower: Column) -> Column:
    if TRIGGERS[kind] is None:
        return F.lit(True)
    out = F.lit(False)
    for t in TRIGGERS[kind]:
        out = out | lower.contains(t)
    return out


#: Words that stand for one another in messages, and messages made of them.
SLOTS = {
    "script": ["javascript", "java script", "scripts", "scripting"], "page": ["page", "site", "website", "content", "gallery", "app"], "put": ["insert", "enter", "type", "put", "edit", "add"],
    "what": ["image caption", "caption", "photo description", "image description", "description of the image", "description", "headline", "title", "alt text"], "off": ["disabled", "turned off", "switched off", "blocked"], "on": ["enabled", "switched on", "turned on", "allowed"],
}
MESSAGES = [
    "this {page} requires {script} to", "this {page} needs {script} to", "we're sorry but this {page} doesn't work properly without {script}", "{script} must be {on} to view", "please enable {script} to view", "turn {script} on and reload", "you need to enable {script} to",
    "{script} is {off} in your browser", "{script} are {off} in your browser", "{put} {what} here", "your {what} goes here", "{what} tk, do not publish",
    "su navegador tiene los scripts desactivados", "esta página precisa de scripts ativados", "es necesario habilitar los scripts", "cal activar javascript", "ce site ne fonctionne pas sans scripts", "veuillez activer javascript", "diese galerie benötigt aktivierte skripte",
    "bitte javascript aktivieren", "the requested address was not found on this server", "the page you are looking for does not exist", "your session has expired", "access denied: you do not have permission", "this content is not available in your region",
    "fatal error: out of memory", "warning: undefined variable", "could not connect to the database", "image could not be loaded", "checking your browser before you continue", "connection timed out after", "request blocked", "something went wrong", "oops! something went wrong",
    "service temporarily down", "nullreferenceerror at render", "página no encontrada", "página não encontrada", "pàgina no trobada", "page introuvable", "seite nicht gefunden", "accès refusé : la session a expiré", "zugriff verweigert", "acceso denegado", "acesso negado",
    "s'ha produït un error intern", "error interno del servidor", "interner fehler", "translation missing", "escriba aquí la descripción", "escriviu aquí el peu de foto", "escreva aqui a legenda", "saisissez la légende ici", "hier bildunterschrift eingeben",
    "beispieltext, bitte ersetzen", "texte d'exemple à remplacer", "texto de ejemplo para la imagen", "pie de foto de muestra, sustituir", "text de mostra, cal canviar-lo",
]


def _expanded(message: str) -> list[str]:
    """A message with each of the words that may stand in its slots."""
    names = re.findall(r"\{(\w+)\}", message)
    return [message.format(**dict(zip(names, words))) for words in itertools.product(*(SLOTS[n] for n in names))]


#: Messages as they begin, to know those that were cut short. Some forms are not good English ("scripts is"): programs fill slots as well.
BEGINNINGS = [m for message in MESSAGES for m in _expanded(message)]
#: Least length at which a beginning tells.
LEAST_BEGINNING = 12
#: What stands between real text and a message.
SEPARATOR = r"\s+[|/·•»›–—-]+\s+"

#: Least share of a text that its residue must take up.
DENSITY = 0.02

#: Short phrases of messages, to know those that an ellipsis cuts.
PHRASES = [
    "failed to render", "failed to load", "failed to fetch", "internal server error", "service unavailable", "page not found", "could not be loaded", "session has expired", "access denied", "something went wrong",
    "temporarily unavailable", "please try again later", "please enable javascript", "requires javascript", "lorem ipsum dolor sit amet",
]


def _cut(phrase: str, least: int) -> str:
    """A pattern for a phrase that ends anywhere from so many characters on."""
    out = ""
    for c in reversed(phrase[least:]):
        out = f"(?:{re.escape(c)}{out})?"
    return re.escape(phrase[:least]) + out

#: Signs that may be written as character references or percent escapes.
_ESCAPES = [
    (r"%7B|&#0*123;|&#x0*7b;|&lbrace;|&lcub;", "{"), (r"%7D|&#0*125;|&#x0*7d;|&rbrace;|&rcub;", "}"), (r"%5B|&#0*91;|&#x0*5b;|&lbrack;|&lsqb;", "["),
    (r"%5D|&#0*93;|&#x0*5d;|&rbrack;|&rsqb;", "]"), (r"%3C|&#0*60;|&#x0*3c;|&lt;", "<"), (r"%3E|&#0*62;|&#x0*3e;|&gt;", ">"),
    (r"%24|&#0*36;|&#x0*24;|&dollar;", "\\$"), (r"%23|&#0*35;|&#x0*23;|&num;", "#"), (r"%40|&#0*64;|&#x0*40;|&commat;", "@"),
    (r"%7C|&#0*124;|&#x0*7c;|&vert;", "|"), (r"%20|&nbsp;|&#0*160;", " "), (r"%25|&#0*37;|&#x0*25;|&percnt;", "%"),
]


def signs_unescaped(c: Column) -> Column:
    """Template signs written as escapes, read as signs (escapes of escapes too)."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)&amp;(?=#|[a-z]{2,8};)", "&"), r"(?i)%25(?=[0-9a-f]{2})", "%")
    for pattern, sign in _ESCAPES:
        c = F.regexp_replace(c, "(?iu)" + pattern, sign)
    return c


#: A known message or phrase, at least half of it, before an ellipsis at the end; a status number with words that are cut.
_ELLIPSIS = r"\s*(?:…|\.\.\.)\s*$"
CUT_MESSAGE = "(?iu)(?:" + "|".join([
    rf"\b(?:{'|'.join(_cut(bare(p), max(8, len(p) // 2)) for p in [*PHRASES, *BEGINNINGS])})",
    r"\b(?:http|status(?: code)?|error(?: code)?)[\s:#]*[45]\d\d\b[\s\p{P}]*\p{L}[\p{L}\s]{0,30}",
]) + f"){_ELLIPSIS}"


def cut_short(lower: Column) -> Column:
    """Whether a field (in bare form), or a part of it between separators, is no more than the beginning of a known message, or an ellipsis cuts one."""
    beginnings = [bare(b) for b in BEGINNINGS]
    heads = [b[:LEAST_BEGINNING] for b in beginnings]

    def is_beginning(part: Column) -> Column:
        start = F.regexp_replace(part, r"^\s+|[\s.…]+$", "")
        return F.substring(start, 1, LEAST_BEGINNING).isin(heads) & F.exists(F.array(*map(F.lit, beginnings)), lambda m: m.startswith(start))

    parts = F.split(lower, SEPARATOR)
    cut = F.when(lower.rlike(r"(?:…|\.\.\.)\s*$"), lower.rlike(CUT_MESSAGE)).otherwise(False)
    return is_beginning(lower) | cut | F.when(lower.rlike(SEPARATOR), F.exists(parts, is_beginning)).otherwise(False)


def _residue(text: Column, pattern: str, mentions: str) -> Column:
    """Whether what matches a pattern outside mentions takes up enough of the text."""
    left = F.regexp_replace(text, mentions, " ")
    return left.rlike(pattern) & (F.length(left) - F.length(F.regexp_replace(left, pattern, "")) >= F.length(text) * DENSITY)


def residue_kind(c: Column) -> Column:
    """What a field holds instead of content: placeholder, value, filler, error or scripts; null for a sound field."""

    def kind(x: Column, lower: Column) -> Column:
        # the pattern by itself is searched first: nearly all fields have no match, and only matches need the second look
        dense = lambda text, pattern, mentions: text.rlike(pattern) & _residue(text, pattern, mentions)
        return (
            F.when(_may_be("placeholder", lower) & dense(x, PLACEHOLDER, MENTIONED), "placeholder")
            .when(_may_be("value", lower) & x.rlike(VALUES), "value")
            .when(x.rlike(REPEATED) | _may_be("filler", lower) & dense(lower, FILLER, QUOTED), "filler")
            .when(_may_be("error", lower) & dense(lower, ERRORS, QUOTED), "error")
            .when(_may_be("scripts", lower) & dense(lower, SCRIPTS, QUOTED), "scripts")
            .when(cut_short(lower), "error")
        )

    def judged(text: Column) -> Column:
        return F.transform(F.array(F.struct(text.alias("x"), bare_column(text).alias("lower"))), lambda t: kind(t["x"], t["lower"]))[0]

    plain = F.regexp_replace(c, r"[\s\x{00A0}\x{200B}\x{FEFF}]+", " ")
    escaped = (c.contains("%") | c.contains("&")) & c.rlike(r"(?i)%[0-9a-f]{2}|&#?\w+;")
    return F.coalesce(judged(plain), F.when(escaped, judged(signs_unescaped(plain))))


def fields_with_residue(df: DataFrame, fields: list[str], id_col: str = "row_id") -> DataFrame:
    """(row_id, field_name, kind): one row per field with residue."""
    long = df.select(F.col(id_col).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("f"))
    return long.select("row_id", "f.field_name", residue_kind(F.col("f.text")).alias("kind")).filter("kind is not null")


def without_residue(df: DataFrame, fields: list[str]) -> DataFrame:
    """The records none of whose fields holds residue."""
    bad = F.lit(False)
    for f in fields:
        bad = bad | residue_kind(F.col(f)).isNotNull()
    return df.filter(~bad)


FIELDS = ["img_alt_text", "img_title"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields_with_residue(table(spark, sf_dir, "images_meta"), FIELDS).select("row_id", "field_name")


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by field and kind."""
    return fields_with_residue(table(spark, sf_dir, "images_meta"), FIELDS).groupBy("field_name", "kind").agg(F.count("*").alias("n_fields"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id of the records that stay."""
    return without_residue(table(spark, sf_dir, "images_meta"), FIELDS).select("row_id")


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p3_kinds": p3_kinds}
