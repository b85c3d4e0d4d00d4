r"""Template residue, filler, error pages and notices about scripts.

Method: texts are cut into sentences; numbers, addresses and dates are masked, case and white space evened out; every
sentence is hashed, and the texts and sources of each hash are counted exactly across the whole collection. Sentences that
hold a slot or a cue (a word or shape without which no rule can fire) carry their form; each distinct form is classified
once, by placeholder and phrase rules. One that recurs widely (in ``WIDE_TEXTS`` texts and ``WIDE_SOURCES`` sources) is
also tried with the wider rules for messages that no list foresees: it addresses the reader and speaks of what failed or is
missing. The classes go back to the texts by hash. A mention is no case: quoted spans are taken out before phrases are
looked for, a phrase counts only where a message may begin and end, and a placeholder in a sentence that talks about
templates, prompts or markup is left alone.

At scale: a text becomes one row with its hashes and its few forms, written once. Counting shuffles (hash, source) after a
count in each map task. Distinct forms are far fewer than sentences. A form in more than one in ``HOT_SHARE`` of the rows
goes back by broadcast (there can be no more than ``HOT_SHARE`` of them), the others by a shuffle.

Defined cases
* null, empty and blank texts: no case. A null source: a source of its own. A null id: comes out as null if it is a case.
* a text of many cases: one row (``residue``) or one row for each class (``found``). Repeated rows: one row; each counts as
  a text for the recurrence.
* very long texts: whole. Ties: none, rules are read in a fixed order. Columns besides those named: not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaframe.session import cut

WIDE_TEXTS, WIDE_SOURCES = 5, 2
#: At most so many forms can hold more than the 1 / HOT_SHARE part of the rows each: the bound of what is broadcast.
HOT_SHARE = 2000

_NAME = r"[A-Za-z_][A-Za-z0-9_.]*(?: [A-Za-z]{2,12}){0,2}"
_LONG = r"[A-Za-z_][A-Za-z0-9_.]{2,}(?: [A-Za-z]{2,12}){0,2}"
#: Tags that belong to a page or to a prompt, so that they are no slots. Fixed values.
_TAGS = (
    r"(?:a|abbr|article|aside|audio|b|blockquote|body|br|button|canvas|code|div|em|error|figure|footer|form|h[1-6]|head|header|hr|"
    r"html|i|iframe|image|img|input|label|li|link|main|message|meta|nav|noscript|ol|option|p|pre|script|section|select|small|"
    r"span|strong|style|sub|sup|svg|table|tbody|td|template|textarea|th|thead|title|tr|u|ul|video|im_start|im_end|pad|unk|bos|eos|mask)"
)

#: A slot that looks like a tag: not in a sentence that closes a tag. Fixed values.
TAG_SLOT = rf"(?<!<)<(?!{_TAGS}\s*/?>){_LONG}\s*/?>(?!>)"
#: Ways to write a slot. Fixed values.
SLOTS = [
    rf"\{{\{{\{{?\s*(?:{_NAME})?\s*\}}?\}}\}}",
    rf'(?<![\\^}}\w$])(?<!":\s{{0,3}})(?<![\[,]\s{{0,3}})\{{\s*\}}',
    rf'(?<![\\^}}\w${{])(?<!":\s{{0,3}})\{{\s*(?:{_NAME}|\d{{1,2}})\s*\}}(?!\}})',
    rf"\$\{{\s*{_NAME}\s*\}}",
    rf"(?<![\w$])\${_LONG}\$(?![\w$])",
    rf"%\(\s*{_NAME}\s*\)[sd]",
    rf"(?<![\w%])%{_LONG}%",
    r"(?<![\w%])%[sd]s?(?!\w)",
    rf"\[\[\s*{_NAME}\s*\]\]",
    r"(?i:\[(?:your|insert|enter|add) [^\[\]\n]{2,}\])",
    r"\[(?:TBD|TK|TODO|TBA|XX+)\]",
    rf"(?<![\w\[])\[(?!(?:null|true|false|none|sic|image|link|inst|sep|cls|pad|mask|unk)\]){_LONG}\](?![\](])",
    rf"<<\s*{_NAME}\s*>>",
    rf"<%=?\s*{_NAME}\s*%>",
    rf"\{{%\s*{_NAME}\s*%\}}",
    r"(?i:<(?:insert|your|enter) [^<>\n]{2,}>)",
    rf"(?<!\w)TBD:\s?{_NAME}",
    r"(?<![\w-])X{4,}(?![\w-])",
    r"(?<![\w?!])\?{4,}",
    rf"@@\s*{_NAME}\s*@@",
    rf"(?<![\w#])#{_LONG}#",
    rf"(?<![\w~])~{_LONG}~",
    rf"(?<![\w|<])\|{_LONG}\|(?![\w|>])",
    rf"(?<![\w:]):{_LONG}:(?![\w:/])",
    rf"(?<!\w)__(?!(?:init|main|name|file|all|str|repr|call|doc|dict|class)__){_LONG}__",
    r"(?<![\w_])_{3,}(?!_)",
    rf"(?i:\({_NAME} goes here\))",
]
#: Words of a sentence that talks about templates, prompts, markup or wording instead of being an unfilled one. Fixed values.
EXPLAINS = (
    r"(?iu)\b(?:templates?|placeholders?|slots?|variables?|syntax|notation|markup|markers?|format strings?|string literals?|regex(?:es)?|curly braces?|brackets|tutorials?|manuals?|guides?|docs|documentation|"
    r"the (?:word|words|string|strings|tag|tags|token|tokens|mark|marks)|wrote|written as|is spelled|spelt|stands? for|denotes?|refers? to|rejects?|rejected|escapes?|escaped|documents?|documented|explains?|explained|"
    r"(?:is|are|was|were|gets?|be) (?:replaced|substituted|filled|expanded|rendered)|yields?|expands? to)\b|"
    r"\b(?:vorlagen?|platzhalter|schreibweise|plantillas?|marcador(?:es)?|gabarits?|modèles? de (?:question|texte|phrase|page|document))\b|(?:wird|werden) [^.]*ersetzt|\b(?:est|sont) remplacée?s?|\bremplacée?s? (?:par|avant)|\b(?:se )?sustituye|"
    r"\bf\"[^\"]*\{|\\(?:frac|sum|int|sqrt|text|mathbb)\b"
)

_LATIN = (
    "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|et|labore|dolore|magna|aliqua|"
    "enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|"
    "reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|"
    "culpa|qui|officia|deserunt|mollit|anim|id|est|laborum"
)
LATIN = rf"(?:\b(?:{_LATIN})\b[\s,.]*){{6}}"


def _runs() -> str:
    """Three and more neighbouring keys of a keyboard row, as long as it goes: one alternative for each first key."""

    def from_(row: str, i: int) -> str:
        tail = ""
        for c in reversed(row[i + 3 :]):
            tail = f"(?:{c}{tail})?"
        return row[i : i + 3] + tail

    return "|".join(from_(r, i) for r in ("qwertyuiop", "asdfghjkl", "zxcvbnm") for i in range(len(r) - 2))


_KEYS = rf"(?>(?:{_runs()}){{1,12}}+[a-z]{{0,2}}|a{{2,40}}+|x{{3,40}}+|(?:kj){{1,20}}+k?|(?:jk){{1,20}}+j?l?)"
MASHED = rf"(?:^|\s)(?:{_KEYS}\W{{1,3}}){{3}}{_KEYS}(?:\W|$)|^(?:(?:{_runs()}){{2,12}}+|(?:{_KEYS}\W{{0,3}}){{2,8}})$"
_W = r"\p{L}{2,12}"
_GAP = r"[ ,]{1,3}"
#: A word that comes four times with no more than three words between: what four equal phrases of up to four words always hold.
_AGAIN = rf"(?<!\p{{L}})({_W})" + rf"{_GAP}(?:{_W}{_GAP}){{0,3}}?\1" * 3
#: One to four words, four times over.
FOUR_TIMES = "|".join(rf"(?<!\p{{L}})({_W}{(' ' + _W) * k}+)(?:{_GAP}\{k + 1}){{3}}(?!\p{{L}})" for k in range(4))
#: One to four words, three times, and nothing else.
ONLY_REPEATED = "^(?:" + "|".join(rf"({_W}{(' ' + _W) * k}+)(?:{_GAP}\{k + 1}){{2}}\W*$" for k in range(4)) + ")"

#: Words of pseudo-Latin that are no words of the languages around it. Fixed values.
_LATIN_ONLY = (
    "lorem|ipsum|dolor|amet|consectetur|adipiscing|eiusmod|tempor|incididunt|labore|dolore|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|aute|irure|"
    "reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum"
)
#: One to four words that follow on themselves: what all repeats hold.
TWICE = rf"(?<!\p{{L}})({_W}(?: {_W}){{0,3}}?){_GAP}\1(?!\p{{L}})"

#: What a text is made of, in the stock sentences that stand in its place. Fixed values.
_PART = r"(?:caption|description|text|title|heading|answer|question|name|content|notes?|summary|comments?|message|label|paragraph|sentence|entry|body|bio|headline|abstract|story|details?)"
#: Stock sentences that stand where content should be, whole. Fixed values.
FILLER = [
    rf"(?:your|my|the|this|some|insert|add|put|write) (?:[\w'’-]+ ){{0,3}}?{_PART}s? (?:goes |will go |belongs |comes |will be |to go )?(?:in )?here",
    rf"(?:please )?(?:enter|type|write|put|add|insert|paste|provide|fill in) (?:[\w'’-]+ ){{1,5}}(?:here|below|(?:in|into) (?:this|the) (?:box|field|area|form|space))",
    rf"(?:please )?(?:enter|type|insert|paste|add|write) your (?:[\w'’-]+ ){{0,2}}[\w'’-]+(?: here)?",
    rf"(?:this is |here is )?(?:an? |the |some |just )?(?:sample|dummy|placeholder|example|test|filler|default|demo|mock|boilerplate) {_PART}s?\b[^.!?]{{0,40}}",
    rf"{_PART} (?:to be (?:added|written|determined|announced|completed|confirmed|done|supplied|provided)|to follow|to come|coming soon|goes here|will follow|will be added(?: later| soon)?|pending|tbd|tba|missing, please add)",
    rf"(?:this|the|me|these)? ?(?:{_PART} )?(?:to be (?:determined|announced|written|completed|added|replaced|filled in)(?: later| soon)?|coming soon|under construction|work in progress|content pending)",
    rf"(?:please )?(?:replace|edit|change|overwrite|update|delete|remove) (?:this|the|me)(?: (?:sample|dummy|placeholder|example|default))?(?: {_PART})?(?: (?:with|by|before) [^.!?]{{1,40}})?",
    rf"(?:no|without) {_PART} (?:available|provided|entered|given|yet|has been (?:added|provided|entered))(?: yet)?",
    r"type something(?:\W+type something)*|(?:insert|your) (?:text|caption) here",
    r"hier (?:steht|folgt|kommt) (?:später |bald |noch )?(?:der|die|das|ihr|ein|eine)? ?\p{L}+|hier (?:\p{L}+ )?(?:text|beschreibung|titel) (?:einfügen|eingeben|eintragen)|(?:blind|platzhalter|muster|beispiel)text\b[^.!?]{0,40}|(?:text|beschreibung|inhalt|titel) (?:folgt|kommt)(?: noch| bald| später| in kürze)?",
    r"(?:la|le|votre|un|une|du) ?(?:description|texte|légende|titre|contenu) (?:viendra|ira|sera ajouté\w*|à compléter|à remplacer|à venir|ici)\b[^.!?]{0,30}|texte (?:à remplacer|de remplissage|factice|d['’]exemple|à venir|ici)|(?:description|légende|titre|contenu) (?:à venir|à compléter)|(?:insérez|saisissez|entrez|écrivez) (?:votre|le|la|un|une) [^.!?]{1,40} ici",
    r"aquí (?:va|irá|viene|aparecerá) (?:la|el|su|tu|un|una) \p{L}+|texto de (?:relleno|prueba|ejemplo|muestra)\b[^.!?]{0,30}|(?:descripción|título|contenido|texto) (?:pendiente|por definir|próximamente)|(?:escriba|introduzca|inserte|ingrese|escribe) (?:su|tu|el|la|un|una|aquí) [^.!?]{0,40}",
]
#: Repeats of one stock phrase, wherever they stand.
TYPED = r"(?:type something\W+){2}"

#: Reasons that follow a status code. Fixed values.
_REASONS = (
    "bad request|unauthorized|payment required|forbidden|(?:page |file )?not found|method not allowed|not acceptable|request time-?out|conflict|gone|"
    "too many requests|internal server error|(?:internal )?error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out"
)
STATUS = rf"(?<!\w)(?:http |status |error )?\d{{1,9}}(?: ?[-–—|:(] ?| )(?:{_REASONS})\b(?=\W*(?:$|\s(?-i:\p{{Lu}}))|\s*[|)<:.!–—-]|\s+(?:nginx|apache|cloudflare|openresty|microsoft-iis)\b)"
#: A code after a word for it, where a message begins, with nothing or the start of a message after it.
CODE = r"(?:http(?:/\d(?:\.\d)?)?|error|status|status code|error code|fehler|erreur|código|code)[ :#]{1,2}[45]\d\d\b(?=\W*$|\W*\s(?-i:\p{Lu})|\s*[|:(–—-])"
#: Where a message may begin: at the start, after the end of another or a divider, or at a capital letter.
_BEGIN = r"(?:^|(?<=[.!?:;|>•*©–—#-]) ?|(?<= )(?=(?-i:\p{Lu})))[\W_]{0,9}(?:(?:sorry|oops|ups|whoops|uh[ -]oh|error|warning|notice|attention|hinweis|fehler|désolé|erreur|lo sentimos|error|aviso|reason|detail|message|status)\b[\W_]{1,4}){0,3}?"
#: Where it may end: at the end of the sentence, before markup or a capital letter, or before what to do.
_NEXT = r"(?:please|try|retry|sorry|slow down|check|contact|go|return|reload|refresh|come|bitte|versuchen|veuillez|réessayez|merci|inténtelo|intente|vuelva|por favor|or |and (?:may|might|could)\b)"
_STOP = rf"(?=\W{{0,3}}$|\s*[.!?;:<|(]|\s*[–—-]+(?:\s|$)|\s*, ?{_NEXT}|\s+(?:{_NEXT}|[\d©]|(?:for (?:the|a) (?:moment|while)|(?:right )?now|at (?:this|the) (?:time|moment)|(?:for )?maintenance|anymore|any more|any longer|on (?:this|our) (?:server|site|host|system)|in (?:your|this) (?:country|region|area|location|browser)|momentarily|temporarily)\b)|\s+(?-i:\p{{Lu}}))"
_THING = (
    r"(?:page|web ?page|scene|view|record|request|caption|servers?|service|file|content|link|url|address|annotation|session|token|site|website|web ?site|document|resource|item|entry|image|picture|photo|video|media|article|"
    r"post|gateway|host|proxy|connection|database|account|app|application|system|feed|form|product|upload|download|operation|transaction|login|domain|backend|upstream|listing|profile|feature|tool|viewer|map)"
)
_CANNOT = r"(?:could not|cannot|can ?not|can['’]t|couldn['’]t|was unable to|were unable to|is unable to|are unable to|failed to)"
_DONE = r"(?:found|loaded|completed|displayed|opened|reached|processed|located|accessed|retrieved|established|verified|shown|fetched|saved|rendered|resolved|handled|authenticated|played|downloaded|uploaded|started)"
_LOST = r"(?:removed|deleted|moved|disabled|suspended|blocked|restricted|archived|closed|taken down|withdrawn|discontinued|terminated)"
#: Messages, each where one may begin. Fixed values.
MESSAGES = [
    rf"(?:(?:the|this|that|your|our|an?|requested) )?(?:[a-z-]+ ){{0,2}}?{_THING}(?: (?:that |which )?(?:you|we)(?:['’]re|['’]ve| are| have| were)? (?:opened|requested|asked for|looking for|followed|clicked|entered|want(?:ed)?|tried to \w+|trying to \w+))? "
    rf"(?:(?:is|are|was|has become) (?:temporarily |currently |no longer |not |not currently |presently )?(?:unavailable|available|accessible|down|offline|broken|invalid|expired|overloaded|busy|supported|responding|working|under (?:maintenance|construction)|down for maintenance|missing|not found|found|refused|denied|rejected|{_LOST})|"
    rf"(?:could not|cannot|can ?not|can['’]t|couldn['’]t|may not) be {_DONE}|(?:has|have|may have|might have) (?:been {_LOST}|ended|expired|timed out|crashed|failed|moved|stopped)|timed out|"
    rf"(?:did not|didn['’]t|does not|doesn['’]t|is not|isn['’]t) (?:respond(?:ing)?|exist|load|answer|work(?:ing)?)(?: in time)?|(?:has )?(?:failed|crashed)(?: with an? (?:\w+ ){{0,2}}error| to (?:load|respond|start|open|connect|complete|process|render))?|took too long(?: to \w+)?|not found|expired|unavailable|fetch failed){_STOP}",
    rf"(?:access (?:is |was |has been )?(?:denied|forbidden|restricted|blocked)|permission denied|something (?:has )?(?:went|gone) wrong(?: on (?:our|the server|the other) (?:side|end))?|an? (?:\w+ ){{0,2}}error (?:has )?(?:occurred|happened|was encountered)|too many (?:requests|redirects|attempts|connections)|connection (?:was )?(?:reset|refused|closed|lost|timed out|failed)|"
    rf"(?:request|gateway|session|operation|connection) time-?out|internal (?:server )?error|(?:page|file) not found|service (?:temporarily )?unavailable|forbidden|unauthori[sz]ed|bad (?:gateway|request)|(?:application|server|runtime|fatal|database|network|unknown|unexpected) error|rate limit exceeded|error (?:establishing|connecting to|loading|opening|reading|fetching|processing) (?:the |this |your |a |an )?(?:[a-z-]+ ){{0,2}}?{_THING}|quota exceeded|no (?:internet|network) connection|under maintenance|down for maintenance)"
    rf"(?: (?:to|by|for|on|from) (?:this |the |that |your |our )?(?:[a-z]+ )?(?:{_THING}|peer|user|ip)| while \w+ing [^.!?,]{{1,40}})?{_STOP}",
    rf"(?:(?:we['’]?re|we are|i['’]?m|i am) sorry,? ?(?:but )?)?(?:we|the (?:server|system|site|page|app|application|browser)|your (?:browser|request)) {_CANNOT} (?:be )?(?:find|load|open|process|complete|reach|verify|display|show|connect(?: to)?|retrieve|fetch|locate|access|handle|understand|play|render|save|log you in|{_DONE})(?: (?:the|this|that|your|any|what|an?)(?: [a-z-]+){{0,2}}? (?:{_THING}|results?|data|you['’]re looking for|you were looking for|you are looking for)| it| you)?{_STOP}",
    rf"(?:unable|failed) to (?:load|open|connect(?: to)?|reach|find|process|fetch|display|retrieve|establish|resolve|start|render|save|play|access|parse|read|write)(?: (?:the|this|that|your|a|an))?(?: [a-z-]+){{0,2}}?(?: (?:{_THING}|data|results?))?{_STOP}",
    rf"you (?:do not|don['’]t|no longer) have (?:the )?(?:necessary |sufficient |required )?(?:permissions?|access|authorization|rights)|you are not (?:authori[sz]ed|allowed|permitted|logged in|signed in)|you (?:have been|were|are being) (?:logged out|signed out|blocked|redirected|rate limited)|(?:please )?(?:sign|log) ?in (?:again|to (?:continue|view|access|proceed|see))|you must (?:be logged in|log in|sign in)",
    rf"(?:our )?(?:site|website|server|servers|service|system|we|page)(?:['’]re| is| are) (?:currently |temporarily )?(?:undergoing|performing|down for|under|experiencing|having) (?:\w+ ){{0,2}}(?:maintenance|technical (?:difficulties|problems|issues)|outage|high (?:traffic|load)|problems){_STOP}",
    rf"(?:die|der|das|diese[rs]?|ihre?|angeforderte\w?) (?:\p{{L}}+ ){{0,2}}?(?:seite|szene|anfrage|datensatz|sitzung|dienst|server|ansicht|eintrag|inhalt|datei|dokument|ressource|verbindung|vorgang|bild|adresse|konto)(?:,? die sie [^.,]{{1,40}},)? (?:wurde (?:abgelehnt|nicht gefunden|entfernt|gelöscht|verschoben|gesperrt|unterbrochen|abgebrochen|zurückgesetzt)|"
    rf"(?:konnte|kann)(?: derzeit| zurzeit)? nicht (?:geladen|gefunden|abgeschlossen|bearbeitet|angezeigt|geöffnet|erreicht|hergestellt|verarbeitet) werden|ist (?:zurzeit |derzeit |momentan |vorübergehend |leider )?(?:nicht (?:verfügbar|erreichbar|mehr verfügbar|vorhanden)|abgelaufen|gesperrt|überlastet|offline)|antwortet nicht(?: mehr)?|existiert nicht(?: mehr)?|fehlgeschlagen){_STOP}",
    rf"(?:zugriff (?:wurde )?verweigert|interner serverfehler|wegen wartungsarbeiten (?:nicht|derzeit)[^.!?]{{0,30}}|(?:es ist )?(?:ein|leider ein) (?:\p{{L}}+ )?fehler (?:ist )?aufgetreten|etwas ist schiefgelaufen|da ist etwas schiefgelaufen|zu viele anfragen|(?:seite|datei) nicht gefunden|zeitüberschreitung[^.!?]{{0,30}}|dienst nicht verfügbar|keine berechtigung|sie haben keine berechtigung[^.!?]{{0,40}}){_STOP}",
    rf"(?:la|le|cette|ce|cet|votre|l['’]) ?(?:page|scène|fiche|demande|requête|session|vue|service|serveur|contenu|fichier|document|ressource|connexion|image|adresse|compte|site)(?: (?:demandée?|recherchée?|que vous \p{{L}}+(?: \p{{L}}+)?))? (?:est (?:temporairement |actuellement |momentanément )?(?:introuvable|indisponible|inaccessible|expirée?|bloquée?|hors ligne|en maintenance)|"
    rf"n['’]a pas pu (?:être )?\p{{L}}+|n['’]a pas été trouvée?|a été (?:refusée?|supprimée?|rejetée?|déplacée?|interrompue?|désactivée?)|a (?:expiré|échoué)|n['’]existe (?:pas|plus)|ne répond (?:pas|plus)|n['’]est (?:pas|plus) (?:disponible|accessible)){_STOP[:-1]}|\s+pour le moment)",
    rf"(?:accès (?:refusé|interdit)|(?:une )?erreur (?:interne|inattendue|inconnue)(?: (?:est survenue|s['’]est produite))?(?: du serveur)?|une erreur (?:est survenue|s['’]est produite)|service (?:momentanément |temporairement )?indisponible|erreur interne du serveur|trop de requêtes|page (?:introuvable|non trouvée)|délai (?:d['’]attente )?dépassé|vous n['’](?:avez pas|êtes pas) (?:la permission|l['’]autorisation|autorisée?)[^.!?]{{0,40}}|impossible (?:de|d['’]) ?(?:charger|afficher|ouvrir|trouver|accéder)[^.!?]{{0,40}}){_STOP}",
    rf"(?:la|el|esta|este|su|tu) (?:página|escena|ficha|solicitud|sesión|vista|servicio|servidor|contenido|archivo|documento|recurso|conexión|imagen|dirección|cuenta|sitio)(?: (?:solicitad[ao]|que (?:busca|solicitó|buscas)))? (?:no (?:fue encontrad[ao]|(?:está|se encuentra) disponible|se (?:pudo|puede|ha podido) \p{{L}}+|existe|responde)|"
    rf"fue (?:rechazad[ao]|eliminad[ao]|movid[ao]|bloquead[ao])|ha (?:caducado|expirado|fallado|sido \p{{L}}+)|está (?:temporalmente )?(?:fuera de servicio|en mantenimiento|caíd[ao])|falló)(?! en \d)(?=\W|$)",
    rf"(?:acceso (?:denegado|prohibido|restringido)|(?:se (?:produjo|ha producido)|ha ocurrido|ocurrió) un error[^.!?]{{0,40}}|algo salió mal|no se (?:encontró|pudo encontrar|pudo cargar|puede mostrar) (?:la|el|esta|este)[^.!?]{{0,40}}|servicio no disponible|error interno del servidor|demasiadas solicitudes|(?:página|archivo) no encontrad[ao]|tiempo de espera agotado|no tiene (?:permisos?|autorización)[^.!?]{{0,40}}){_STOP}",
]
_JS = r"(?:java ?scripts?|js|scripts?|scripting|active scripting)"
_ON = r"(?:enable|activate|turn on|allow|switch on|unblock|re-?enable)"
_APP = r"(?:viewer|page|app|application|web ?app|site|website|web ?site|view|scene|feature|content|form|map|player|widget|service|tool|dashboard|gallery|portal)"
#: Notices that scripts are needed, each where a message may begin. Fixed values.
SCRIPTS = [
    rf"(?:please |kindly |you (?:need|have) to |you(?:['’]ll)? (?:will )?need to |you must |you should |make sure (?:to|you) |try to |first,? )?{_ON} (?:\w+ (?:and|or|&) )?{_JS}\b",
    rf"(?:(?:sorry|we['’]re sorry|we are sorry),? (?:but )?)?(?:the|this|our|it)(?: [a-z-]+){{0,2}}? (?:does(?: not|n['’]t)|cannot|can['’]t|will not|won['’]t) (?:work|run|function|load|start)(?: \w+)? without {_JS}\b",
    rf"(?:{_ON} |turn |switch )?(?:java ?script|active scripting|js) (?:is|are|seems? to be|appears? to be|must be|has to be|needs? to be|should be|may be|has been) (?:currently )?(?:disabled|blocked|required|needed|enabled|activated|deactivated|turned (?:off|on)|switched (?:off|on)|unavailable|not (?:enabled|supported|allowed|available|active|running))\b",
    rf"scripts? (?:is|are|seems? to be|must be|need to be|have been) (?:disabled|blocked|turned off|switched off|not (?:enabled|allowed|supported)|(?:required|needed|enabled|allowed) (?:to (?:view|see|use|open|run|load|show|continue|display)|for this|by this|on this|here))",
    rf"(?:this|the|our|your) (?:[a-z-]+ ){{0,2}}?{_APP} (?:(?:only )?works? (?:best |only )?with|does(?: not|n['’]t) work without|will not work without|won['’]t work without|cannot run without|can['’]t run without|requires|needs|relies on|depends on) (?:\w+ )?{_JS}\b",
    rf"your browser (?:does not|doesn['’]t|cannot|can['’]t|has|is) (?:currently )?(?:\w+ )?(?:run|support|allow|execute|blocking|blocked|disabled|have) ?(?:\w+ )?{_JS}\b|your browser has {_JS} (?:disabled|blocked|turned off|switched off)|your browser (?:blocks|is blocking|has blocked|has disabled) {_JS}\b",
    rf"(?:it (?:looks like|seems|appears)(?: that| as if)?|we(?:['’]ve| have)? (?:detected|noticed|see)(?: that)?|looks like|you seem to|you appear to) (?:you |your browser |to )?(?:have |has |had )?{_JS} (?:is |are |has been )?(?:disabled|blocked|turned off|switched off|not enabled|off)",
    rf"(?:you (?:have|need|must have)|requires?) {_JS} (?:disabled|blocked|turned off|turned on|enabled|active)|(?:without|no) {_JS},? (?:this|the|our|you|nothing|some|enabled)\b|{_JS} (?:required|needed|disabled|not enabled|blocked){_STOP}",
    rf"(?:to|in order to|for) (?:see|view|open|use|load|continue|display|access|proceed|run|get|the|full|best)\b[^.,]{{0,60}},? (?:please |you (?:must|need to|have to) |it is necessary to )?{_ON} (?:\w+ (?:and|or|&) )?{_JS}\b",
    rf"(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:in ihrem browser )?(?:{_JS}|skripte)\b|(?:bitte )?(?:{_JS}|skripte) (?:aktivieren|einschalten|erlauben)|für (?:diese|die) (?:ansicht|seite|anwendung|funktion|darstellung)[^.]{{0,30}} (?:wird|werden) (?:{_JS}|skripte) benötigt|(?:diese|die) (?:seite|ansicht|anwendung|website) (?:benötigt|erfordert|braucht|funktioniert nur mit) (?:{_JS}|skripte)|"
    rf"(?:skripte|{_JS}) (?:sind|ist|muss|müssen) (?:in ihrem browser |auf dieser seite |derzeit |nicht )?(?:deaktiviert|blockiert|gesperrt|ausgeschaltet|abgeschaltet|aktiviert|erforderlich|eingeschaltet)|ihr browser (?:unterstützt kein|blockiert|führt kein|hat) (?:{_JS}|skripte)",
    rf"(?:veuillez |merci d['’]|vous devez )?(?:activer|activez|autorisez|autoriser) (?:le )?(?:{_JS}|les scripts)\b|cette (?:page|vue|application) (?:a besoin de|nécessite|requiert|ne fonctionne pas sans) (?:le )?(?:{_JS}|les scripts)|ce site (?:a besoin de|nécessite|requiert) (?:le )?(?:{_JS}|les scripts)|les scripts sont (?:bloqués|désactivés|nécessaires|requis)|(?:le )?javascript (?:est|doit être|semble) (?:désactivé|requis|nécessaire|activé|bloqué)|votre navigateur (?:bloque|ne prend pas en charge|n['’]exécute pas|a désactivé) (?:le |les )?(?:{_JS})",
    rf"(?:por favor,? |debe |necesita )?(?:active|habilite|activa|habilita|permita|activar|habilitar) (?:el )?(?:{_JS}|los scripts)\b|est[ae] (?:vista|página|aplicación|sitio) (?:necesita|requiere|no funciona sin) (?:el )?(?:{_JS}|los scripts)|su navegador (?:tiene|no admite|no soporta|bloquea|no ejecuta) (?:el |los )?(?:{_JS})\b|(?:el )?javascript (?:está|debe estar) (?:desactivado|deshabilitado|bloqueado|activado|habilitado)|los scripts están (?:bloqueados|desactivados|deshabilitados)|se (?:necesita|requiere) javascript",
]
#: Shapes of programs' messages, anywhere in a sentence. Fixed values.
SHAPES = [
    r"traceback \(most recent call last\)",
    r"^(?:exception in thread \"[^\"]*\" )?(?:uncaught )?(?:[\w$]+\.)*\w*(?:error|exception): \S",
    r"^(?:fatal|parse|syntax|php|warning|notice|uncaught)(?: \w+)? (?:error|warning|exception|notice): \S",
    r"<error>\s*<code>",
    r"""\{\s*"(?:error|status|code|errors)"\s*:\s*(?:\[?\{[^{}]*"message"\s*:|\d{1,9}\s*,\s*"(?:detail|message|error|reason|title)"\s*:|"[^"{}]*"\s*,\s*"(?:message|detail|code|status|error_description|path)"\s*:)""",
    r"^status: \d{1,9}$",
    r"^(?:bash|sh|zsh|/bin/sh): [^:]+: .*(?:command not found|no such file)|segmentation fault \(core dumped\)|^panic: \S|npm err!|sqlstate\[|^ora-\d+:|cannot read propert(?:y|ies) of (?:undefined|null)|undefined is not a function|\bat (?:[\w$]+\.)+[\w$<>]+\([\w$]+\.java:\d+\)|^caused by: (?:[\w$]+\.)+\w+",
]
#: Sentences that count only in forms that recur widely: they address the reader or stand as a status, and speak of what failed,
#: is missing or must be done. Fixed values.
WIDE = [
    r"(?:please )?(?:try|check|come|go) (?:again|back)(?: (?:later|soon|shortly|in an? \w+|in (?:a few|some) \w+|in \d+ \w+|now))?\W*$",
    r"(?:please )?(?:reload|refresh|retry|close|restart|clear|contact|click|tap|press|use|update|disable|wait|stand by|check|verify|confirm|accept|sign in|sign out|log in|go back|return)\b[^.!?]{0,60}\b(?:page|browser|support|administrator|admin|webmaster|cookies?|cache|later|again|connection|continue|link|button|robot|human|team|home|start|address|password|url|go on)\W*$",
    r"(?:we|our \w+|this \w+)(?:['’]re| are| is) (?:currently |still )?(?:working on it|on it|looking into|fixing|aware of|sorry|experiencing|being (?:updated|repaired|moved))\b[^.!?]{0,60}\W*$",
    r"(?:it|this|that)(?: \w+)? (?:may|might|could|must|seems to|appears to) (?:have (?:been )?|be )(?:moved|deleted|removed|renamed|expired|gone|wrong|broken|unavailable|down)\b[^.!?]{0,40}\W*$",
    r"(?:loading|redirecting|verifying|checking|connecting|please wait|one moment|just a moment)\b[^!?]{0,50}(?:\.{2,}|…|please|wait|browser|seconds?|moment)?\W*$",
    r"(?:sorry|oops|whoops|uh[ -]oh|apologies)\b[^.?]{0,80}\W*$",
    r"(?:are you|confirm you are|prove you are|i am|i['’]m) (?:not )?(?:a )?(?:robot|human)\b[^.!]{0,30}\W*$|[^.]{0,40}\bcaptcha\b[^.]{0,40}$",
    r"(?:no|nothing|0) (?:results?|content|data|items?|entries|matches|records?|to (?:see|show|display))(?: (?:was|were|is|are|could be))?(?: (?:found|available|here|yet|to (?:show|display)|for (?:this|your) \w+))+\W*$",
    r"(?:bitte )?versuchen sie es (?:später )?(?:erneut|noch einmal)\b[^.!?]{0,30}\W*$|wir arbeiten daran\W*$|(?:bitte )?laden sie die seite (?:neu|erneut)\W*$|(?:veuillez |merci de )?(?:réessayez|réessayer)(?: plus tard| dans [^.!?]{1,20})?\W*$|nous y travaillons\W*$|(?:por favor,? )?(?:inténtelo|intente|vuelva a intentarlo)(?: de nuevo)?(?: más tarde)?\W*$|estamos trabajando en ello\W*$",
]

_QUOTES = r"\"[^\"]*+\"|“[^“”]*+”|„[^„“”]*+[“”]|«[^«»]*+»|‹[^‹›]*+›"
_TICKS = r"`[^`\n]++`"
_BREAK = r"\r\n?|[\n\x0b\x0c\x85\u2028\u2029]"


def _trie(words: list[str]) -> str:
    """A pattern of words that share their beginnings, so that a scan tries few branches at each place."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for c, tails in heads.items():
        rest = "" if "" in tails else _trie(tails)  # a word ends here: what follows it need not be looked at
        parts.append((r"\ " if c == " " else c) + (f"(?:{rest})" if "|" in rest else rest))
    if len(parts) < 8:
        return "|".join(parts)
    # many branches stand in groups behind a look at the first letter, so that most are passed by at once
    firsts = list(heads)
    groups = [range(i, min(i + 4, len(parts))) for i in range(0, len(parts), 4)]
    return "|".join("(?=[" + "".join(firsts[i].replace("-", r"\-") for i in g) + "])(?:" + "|".join(parts[i] for i in g) + ")" for g in groups)


#: Beginnings of words: a sentence that holds none of them is no message and no stock sentence, whatever else it says. Fixed values.
CUES = [
    # what failed, and how it is said
    "unavail", "not avail", "no longer", "not found", "inaccess", "not access", "offline", "is broken", "invalid", "expired", "overload", "is busy", "not resp", "not supp", "not work", "maintenance", "is missing", "denied", "refused", "rejected", "been removed", "was removed", "been deleted", "was deleted",
    "been moved", "was moved", "has moved", "disabled", "suspended", "blocked", "restricted", "been archived", "been closed", "taken down", "withdrawn", "discontinued", "terminated", "could not be", "cannot be", "can not be", "can't be", "can’t be", "couldn't", "couldn’t", "may not be", "unable", "failed", "crashed", "timed out", "time out", "timeout", "time-out",
    "did not respond", "didn't respond", "didn’t respond", "does not exist", "doesn't exist", "doesn’t exist", "does not respond", "doesn't respond", "not load", "is down", "took too long", "went wrong", "gone wrong", "error", "too many", "connection", "forbidden", "unauthor", "bad gateway", "bad request", "limit exceeded", "quota", "no internet", "no network", "permission", "not auth", "not allowed", "not permitted",
    "we could not", "we cannot", "we can not", "we can't", "we can’t", "we were unable", "has ended", "logged", "log in", "login", "sign in", "signed", "rate limit", "redirect", "undergoing", "experiencing", "technical", "http", "status", "payment req", "method not", "conflict", "gone", "internal server", "not impl", "service temp", "gateway",
    # scripts
    "javascript", "java script", "js", "script", "active scripting",
    # filler
    "here", "enter ", "insert ", "paste ", "type ", "write your", "add your", "put your", "provide your", "fill in", "in this box", "sample", "dummy", "placeholder", "example", "this is a test", "test ", "filler", "default", "demo", "mock", "boilerplate", "to be ", "to follow", "to come", "coming soon", "pending", "tbd", "tba", "will follow", "will be added",
    "under construction", "in progress", "replace", "edit ", "overwrite", "change this", "update this", "delete this", "remove this", "no description", "no caption", "no text", "no title", "no content", "no answer", "no summary", "no comment",
    # widely recurring messages
    "again", "reload", "refresh", "retry", "restart", "contact", "click", "tap", "press ", "wait", "stand by", "please", "verify", "confirm", "accept", "working on", "looking into", "we're on it", "we are on it", "aware of", "sorry", "loading", "connecting", "moment", "oops", "whoops", "uh-oh", "uh oh", "apolog", "robot", "human", "captcha", "no result", "nothing", "no data", "no item", "no entr", "no match", "no record", "may have been", "might have been", "cookie",
    # German, French and Spanish
    "hier", "blindtext", "platzhaltertext", "mustertext", "beispieltext", "folgt", "nicht", "abgelehnt", "entfernt", "gelöscht", "verschoben", "gesperrt", "unterbrochen", "abgebrochen", "zurückgesetzt", "abgelaufen", "überlastet", "fehlgeschlagen", "verweigert", "fehler", "serverfehler", "wartung", "schief", "zu viele", "zeitüber", "berechtigung", "skripte", "versuchen", "wir arbeiten", "laden sie",
    "viendra", "à compléter", "à remplacer", "remplissage", "à venir", "ici", "factice", "introuvable", "indispo", "expiré", "bloqué", "hors ligne", "n'a pas", "n’a pas", "n'est", "n’est", "n'existe", "n’existe", "refusé", "supprim", "rejet", "déplac", "interromp", "désactiv", "échoué", "ne répond", "interdit", "erreur", "trop de", "non trouv", "délai", "impossible", "activer", "activez", "réessay", "nous y", "a été",
    "aquí va", "aquí irá", "aquí viene", "relleno", "de prueba", "de muestra", "de ejemplo", "pendiente", "por definir", "próximamente", "escriba", "introduzca", "ingrese", "no fue", "no está", "no se", "no existe", "no responde", "rechazad", "eliminad", "movid", "bloquead", "caduc", "fallado", "ha sido", "fuera de", "mantenimiento", "caíd", "falló", "denegado", "prohibido", "restringido", "algo salió", "no encontr", "demasiadas", "agotado", "no tiene", "habilit", "active ", "navegador",
    "inténtelo", "intente", "vuelva", "estamos", "se produjo", "se ha producido",
    # programs
    "traceback", "exception", "warning:", "notice:", "segmentation", "panic:", "npm err", "sqlstate", "ora-", "undefined", "caused by", "code", "fatal", "bash:", "sh:", "zsh:",
]

#: On lower case, so that no comparison has to fold it.
_CUED = r"(?<![a-zà-ÿ])(?:" + _trie(CUES) + "|(?:" + _trie(_LATIN_ONLY.split("|")) + r")(?![a-zà-ÿ]))|[a-z](?:error|exception): |\.java:"
_SENTENCE = r"(?<=[.!?])\s+|\s{2,}|[\t\n]"
_SLOT = "|".join(SLOTS)
#: Characters without which a sentence holds no slot: one pass over the text, before the patterns are tried.
_SLOT_CUE = r"[{<$%\[@#~|]|\?{4}|___|__[A-Za-z]|XXXX|TBD:|:[A-Za-z_][A-Za-z0-9_. ]{2,}:|goes here\)"
_SHAPED = r"(?iu)<error>|\{\s*\"(?:error|status|code|errors)\"\s*:"


def _numbers(text: Column) -> Column:
    """Addresses, dates, codes and numbers masked; a status code after its word stays."""
    t = F.when(text.contains("://") | text.contains("www.") | text.contains("WWW.") | text.contains("@"), F.regexp_replace(text, r"(?iu)\b(?:https?|ftp)://\S+|\bwww\.\S+|\b[\w.+-]+@[\w-]+\.[\w.]+", "<address>")).otherwise(text)
    t = F.regexp_replace(t, r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b", "<when>")
    t = F.regexp_replace(t, r"(?i)\b(code|c[óÓ]digo|incident|reference|ray|trace|request)((?: id)?:?) [0-9a-f]{4,}\b", "$1$2 0")
    return F.regexp_replace(t, r"(?=\d)(?<![\w{])(?<!(?i:error|http|status|code)[ :#]{1,2})\d+(?:[.,]\d+)*(?!\w)", "0")


def _even(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def masked(text: Column) -> Column:
    """Addresses, dates, codes and numbers masked; white space made one space."""
    return _even(_numbers(text))


def _any(form: Column, patterns: list[str]) -> Column:
    return form.rlike("(?iu)(?:" + "|".join(patterns) + ")")


def _begun(form: Column, patterns: list[str]) -> Column:
    """True if a message of these begins where one may."""
    return form.rlike(f"(?iu){_BEGIN}(?:{'|'.join(patterns)})")


def _holds_slot(sentence: Column) -> Column:
    return sentence.rlike(_SLOT_CUE) & (sentence.rlike(_SLOT) | (sentence.rlike(TAG_SLOT) & ~sentence.contains("</")))


def _nonsense(lowered: Column) -> Column:
    """Repeats and mashed keys; the patterns are those of lower case."""
    return (lowered.rlike(TWICE) & (lowered.rlike(FOUR_TIMES) | lowered.rlike(ONLY_REPEATED))) | lowered.rlike(MASHED)


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, hashes, forms) of every text that is not blank: the hashes of all its sentences, each once, and the forms
    (view, form) that may be a case. view 0 are sentences with a slot, without inline code; view 1 are sentences without
    inline code and quoted spans that hold a cue, and lines that have the shape of a program's message."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where(F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    cut_up = lambda parts: F.flatten(F.transform(parts, lambda p: F.split(p, _SENTENCE)))
    rows = rows.withColumn("code", F.transform(F.split(F.regexp_replace("text", _BREAK, "\n"), r"\n[ \t]*\n"), lambda p: F.when(p.contains("`"), F.regexp_replace(p, _TICKS, " ")).otherwise(p))).drop("text")
    rows = rows.withColumn("plain", F.transform("code", lambda p: F.when(p.rlike("[\"“„«‹]"), F.regexp_replace(p, _QUOTES, " ' ")).otherwise(p)))
    rows = rows.withColumn("said", F.transform(cut_up(F.transform("plain", _numbers)), _even))
    # both cases in one array: a look at another array by position would compute that array again for each element
    rows = rows.withColumn("said", F.transform("said", lambda s: F.struct(s.alias("form"), F.lower(s).alias("low"))))
    view = lambda k, forms: F.transform(forms, lambda s: F.struct(F.lit(k).alias("view"), s.alias("form")))
    slots = F.transform(F.filter(cut_up(F.filter("code", lambda p: p.rlike(_SLOT_CUE))), _holds_slot), masked)
    shaped = F.transform(F.filter(F.flatten(F.transform(F.filter("code", lambda p: p.rlike(_SHAPED)), lambda p: F.split(p, "\n"))), lambda s: s.rlike(_SHAPED)), masked)
    cued = F.transform(F.filter("said", lambda s: s["low"].rlike(_CUED) | s["low"].rlike(TWICE) | s["low"].rlike(MASHED)), lambda s: s["form"])
    hashes = F.array_distinct(F.transform(F.filter("said", lambda s: s["low"] != ""), lambda s: F.xxhash64(s["low"])))
    return rows.select("id", "source", hashes.alias("hashes"), F.concat(view(0, F.array_distinct(slots)), view(1, F.array_distinct(cued)), view(1, F.array_distinct(shaped))).alias("forms"))


def recurring(rows: DataFrame) -> DataFrame:
    """(hash, texts, sources) of the sentences that recur widely, both counted exactly. rows: as ``sentences`` gives them."""
    per_source = rows.select("source", F.explode("hashes").alias("hash")).groupBy("hash", "source").agg(F.count("*").alias("texts"))
    counted = per_source.groupBy("hash").agg(F.sum("texts").alias("texts"), F.count("*").alias("sources"))
    return counted.where((F.col("texts") >= WIDE_TEXTS) & (F.col("sources") >= WIDE_SOURCES))


def classified(form: Column, view: Column, wide: Column) -> Column:
    """``slot``, ``filler``, ``error`` or ``script``; NULL if the form is none of them."""
    return F.when(view == 0, F.when(~form.rlike(EXPLAINS), "slot")).otherwise(
        F.when((form.rlike(f"(?iu)\\b(?:{_LATIN_ONLY})\\b") & F.lower(form).rlike(LATIN)) | form.rlike("(?iu)" + TYPED) | form.rlike(f"(?iu){_BEGIN}(?:{'|'.join(FILLER)})\\W*$") | F.exists(F.array(F.lower(form)), _nonsense), "filler")
        .when(_begun(form, SCRIPTS), "script")
        .when(_any(form, [*SHAPES, STATUS]) | _begun(form, [CODE, *MESSAGES]), "error")
        .when(wide & _begun(form, WIDE) & ~form.rlike(EXPLAINS), "error")
    )


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(<id>, reason): each text that is a case, with each of its reasons."""
    rows = cut(sentences(df, id_col, text_col, source_col), "sentences")
    said = rows.select("id", F.inline("forms")).select("id", "view", "form", F.lower("form").alias("low"))
    said = said.select("id", "view", "form", F.xxhash64("low").alias("hash"), F.xxhash64("low", F.lit(5), "view").alias("second"))
    forms = said.groupBy("hash", "second").agg(F.min("form").alias("form"), F.min("view").alias("view"), F.count("*").alias("n"))
    forms = forms.join(recurring(rows).select("hash", F.lit(True).alias("wide")), "hash", "left")
    classes = cut(forms.select("hash", "second", "n", classified(F.col("form"), F.col("view"), F.coalesce("wide", F.lit(False))).alias("reason")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(classes.where(F.col("n") * HOT_SHARE > F.lit(total)).select("hash", "second", F.lit(True).alias("is_hot"), F.col("reason").alias("hot_reason")))
    keyed = said.select("id", "hash", "second").join(hot, ["hash", "second"], "left")
    few = classes.where((F.col("n") * HOT_SHARE <= F.lit(total)) & F.col("reason").isNotNull()).select("hash", "second", "reason")
    out = keyed.where(F.col("hot_reason").isNotNull()).select("id", F.col("hot_reason").alias("reason"))
    out = out.unionAll(keyed.where(F.col("is_hot").isNull()).select("id", "hash", "second").join(few, ["hash", "second"]).select("id", "reason"))
    return out.select(F.col("id").alias(id_col), "reason").distinct()


def residue(df: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """(<id>) of the texts that are a case."""
    return found(df, id_col, **columns).select(id_col).distinct()


def without_residue(df: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The rows of df whose text is no case."""
    cases = residue(df, id_col, **columns).withColumnRenamed(id_col, "_case")
    return df.join(cases, df[id_col].eqNullSafe(cases["_case"]), "left_anti")
