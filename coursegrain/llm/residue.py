"""Template residue, filler, error notices and scripts-required notices in texts, by character n-gram models.

Four models (placeholders, filler, error notices, scripts notices) are fitted on examples that rules below put together, one model of
natural prose on the n-gram counts of all documents and on texts that explain such things. A text is scored character by character
with the log-likelihood ratio of each residue model to natural prose; windows of WINDOW characters whose ratio reaches THRESHOLD mark
residue, and a text is excluded when marked windows cover COVER characters or more. All texts are counted and scored in full, many
at once.

Residue is part of the corpus that natural prose is counted on. So that it does not pass for prose there, n-grams are smoothed by a share
of the corpus (RARE): what is no more common than residue may be predicts nothing, at any size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3, 4, 5)
WEIGHTS = (0.02, 0.06, 0.14, 0.28, 0.5)
BITS, FLOOR = 18, 1e-5
#: Share of all characters by which the counts of natural prose are smoothed, the uses that it stands for at least (a few uses are no
#: evidence of prose in a small corpus either), and how many times that each natural example counts.
RARE, FEW, EXAMPLE = 7e-5, 20, 6
WINDOW, THRESHOLD, COVER = 28, 6.5, 8
#: Characters that are scored at once (a longer text alone).
TOGETHER = 1 << 18

#: What is to be filled in, the marks that writers and programs put around it, and the lines it stands in.
SLOTS = "name|full name|first name|user name|email|phone|address|city|company|date|time|title|subject|author|teacher|instructor|student|course|course code|module|unit|lesson|chapter|topic|concept|definition|example|answer|question|link|url|image|price|amount|number|page|grade|deadline|room|term|goal|summary|body|text|party|buyer|seller|sender|recipient|customer|client|speaker|department|school|location|venue|position|role|state|country|total|currency|version|product|project|manager|event|host|guest|group|week|day|month|year|reason|note|signature|order number|id|code|number of pages|office|web site|keyword|reference|source|due date|office hours|slide number|learning outcome|learning goal|reading list|homework|exam date|classroom|credits|contact person|start date|end date|file name|table number".split("|")
MARKS = "{{%s}}|{{ %s }}|{%s}|{{{%s}}}|${%s}|<%%= %s %%>|{%% %s %%}|<%s>|<<%s>>|[%s]|[[%s]]|[your %s here]|[insert %s]|[enter %s]|[add %s here]|[%s goes here]|<insert %s here>|<your %s>|(%s to follow)|(insert %s here)|(your %s)|TODO: %s|TODO add the %s|TBD %s|[TBD: %s]|%%%s%%|__%s__|##%s##|@@%s@@|$%s$|*|%s|*|XXX %s XXX|FIXME %s|[%s to come]|[%s missing]|[%s to be added]|[%s to be filled out]|[fill in %s]|(fill in the %s)|(add %s)|(type the %s)|(enter the %s)|[%s TBD]|XX %s|XXX".replace("*|%s|*", "*%s*").split("|")
LINES = "Dear %s, thank you for %s.|Hello %s,|Welcome to %s!|%s|%s %s|By %s on %s|Due: %s|Taught by %s, %s|Questions? Write to %s.|This agreement is between %s and %s.|Signed by %s for %s|In %s we look at %s.|A %s is %s.|%s: %s|- %s\n- %s|See %s for more.|Objectives: %s; %s|Copyright %s %s".split("|")


def _cased(name: str) -> list[str]:
    under = name.replace(" ", "_")
    return [name, name.title(), name.upper(), under, under.upper(), under.title().replace("_", ""), name.replace(" ", "-"), "user." + under]


def placeholders() -> list[str]:
    marked = [m.replace("%s", n).replace("%%", "%") for k, name in enumerate(SLOTS) for j, m in enumerate(MARKS) for n in (_cased(name)[(k + j) % 8], _cased(name)[(k + j + 3) % 8], name.upper().replace(" ", "_") if (k + j) % 2 else name)]
    out, k = [], 0
    while k < len(marked):
        line = LINES[len(out) % len(LINES)]
        for _ in range(line.count("%s")):
            line = line.replace("%s", marked[k % len(marked)], 1)
            k += 1
        out.append(line)
    return out


#: The usual filler passages, and what editors show where a text has not been written.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas vestibulum tortor quam feugiat vitae ultricies eget tempor sit amet ante donec eu libero sit amet quam egestas semper aenean ultricies mi vitae est mauris placerat eleifend leo
phasellus ultrices nulla quis nibh quisque a lectus donec consectetuer ligula vulputate sem tristique cursus nam nulla quam gravida non commodo a sodales sit amet nisi vivamus suscipit tortor eget felis porttitor volutpat curabitur arcu erat accumsan id imperdiet et"""


def filler() -> list[str]:
    lines = LATIN.split("\n")
    words = sorted(set(LATIN.split()))
    long = [w for w in words if len(w) > 4]
    out = [x[0].upper() + x[1:] + "." for x in lines] + [" ".join(w[:9]).capitalize() + ", " + " ".join(w[9:18]) + "." for x in lines for w in [x.split()[::-1]]]
    # made-up Latin, as generators of filler write it: stems with other endings
    for k in range(160):
        made = [long[(7 * k + 13 * j * j + 5 * j) % len(long)] for j in range(6)]
        out.append(" ".join(w[: max(4, len(w) - 2 - (k + j) % 2)] + ("a", "o", "um", "is", "u", "e", "io", "ora")[(k + 3 * j) % 8] for j, w in enumerate(made)).capitalize() + ".")
    things = "title|subtitle|text|heading|notes|caption|picture|bullet|content|description|paragraph|body|footer|question|answer|name|date".split("|")
    asks = "Click here to add %s|Click to edit %s|Click to enter a %s|Tap to add %s|Type your %s|Type a %s here|Your %s goes here|Enter your %s here|Add a %s|Add %s text|Insert %s here|Put your %s here|%s placeholder|Sample %s|Dummy %s|Write your %s here|Double-click to edit the %s|Replace this %s with your own|This is a sample %s|This %s is only a placeholder|Edit this %s".split("|")
    out += [a.replace("%s", t).replace("a a", "an a") for a, t in product(asks, things)]
    out += [f"{n} level" for n in "First Second Third Fourth Fifth".split()] + [" ".join([w] * n) for w in ("blah", "test", "asdf", "foo", "bla", "text", "xxx", "xxxx", "qwerty", "dummy", "abc", "content") for n in (3, 5)]
    out += "foo bar baz qux|asdf jkl asdf qwer zxcv|asdfghjkl qwertyuiop|lorem lorem lorem|Text to be written. More text to be written.|The final copy will be added later.|Real text comes here.|Content coming soon.|Coming soon|The real text will follow.|This is only dummy text.|This is placeholder copy until the final copy is here.|Copy goes in this place.|Body text, body text, body text.|Chart title|Insert chart title|Insert picture caption here|Insert table caption|Picture caption|Sample text to show the layout.|Replace this with the final text before publishing.|Under construction. This page is still being written.|Page intentionally left blank.|Aaaa bbbb cccc dddd.|1 2 3 test".split("|")
    return out


#: Notices that something could not be had: what, what is wrong with it, and what to do.
STATUS = "400 Bad Request|401 Unauthorized|402 Payment Required|403 Forbidden|404 Not Found|405 Method Not Allowed|406 Not Acceptable|408 Request Timeout|409 Conflict|410 Gone|413 Payload Too Large|429 Too Many Requests|500 Internal Server Error|501 Not Implemented|502 Bad Gateway|503 Service Unavailable|504 Gateway Timeout".split("|")
WHAT = "page|site|server|service|resource|file|document|request|session|connection|link|address|content|video|lesson|course|module|deck|slide|quiz|upload|URL|account|item|database|application".split("|")
WRONG = "was not found|could not be found|cannot be found|does not exist|no longer exists|has been moved|was removed|is unavailable|is currently unavailable|is temporarily unavailable|is not available|is missing|is gone|has expired|timed out|did not respond|failed to load|could not be loaded|cannot be displayed|cannot be opened|could not be read|was refused|was rejected|is locked|is restricted|is blocked|is down for maintenance|is overloaded|is invalid|returned an error|was interrupted|was denied|refused the request|refused to answer|rejected the upload".split("|")
ADVICE = "Please try again.|Try again later.|Please try again in a few minutes.|Reload the page.|Refresh and try again.|Check the address.|Check your connection and try again.|Please contact support.|Contact the administrator if this goes on.|Go back to the home page.|Return to the start page.|Please log in again.|Sign in to continue.|Ask the owner for access.|Tap to retry.|Search the site instead.|We are working on it.|Sorry for the inconvenience.|We apologize for any trouble.|Wait a while and reload.".split("|")
OPENERS = "|Sorry, |Sorry, the |Oops! The |Error: |Error: the |The |The requested |This |Your |Unable to load: the |Something went wrong: the |Notice: the |Warning: the |We are sorry, but the |Whoops, the ".split("|")
MORE_ERRORS = """Something went wrong. An unexpected error occurred. An error has occurred while processing your request.
Access denied. You do not have permission to open this. You are not authorized to see this page. You don't have access to this. Permission required.
Unable to load content. Unable to connect. Could not connect to the server. Failed to fetch. Cannot load this page. No internet connection. Network error.
Oops! We can't find that page. We can't seem to find the page you are looking for. That link may be broken. Nothing found here. No results. Page not found.
Your session timed out. Session expired. Please log in. Login required. Too many attempts. Rate limit exceeded. Quota exceeded. Service busy.
Request ID: 8f2c41d0. Error code: 1020. Reference: 77-A31. Incident number 5512. Trace 90ab12. Ray 6d1f. Node web-07. Path: /var/www/index. Case 4471.
Conversion failed. Export failed. Rendering failed. Import error. Parsing failed: unexpected token. No text could be extracted. No output was produced. File is corrupt. Unsupported format. Unexpected end of input.
Traceback (most recent call last): File "main.py", line 3, in <module>. ValueError: invalid literal. Unhandled exception. Null pointer exception at line 40. Segmentation fault. Stack trace: at Object.run. Fatal error: out of memory. Uncaught TypeError: undefined is not a function.
Connection refused. Connection reset. Host unreachable. DNS lookup failed. Certificate expired. Proxy error. Upstream timed out. Gateway error. Database error. Query failed.
You do not have permission to view this file. Request permission from the owner. Ask the owner to share it. Cookie preferences. Manage cookies. Report this problem. Show details. Incident 90211
Maintenance mode. We will be back shortly. Back soon. Scheduled maintenance. The system is being updated. Server overloaded.
Was this helpful? Yes No. Skip to content. Home | About | Contact | Log in. Accept cookies. All rights reserved. Back to top. Privacy policy. Terms of use. Try one of these pages: Home, Search, Sitemap.
La página no existe. No se pudo cargar la página. No se ha encontrado el recurso. Error interno del servidor. Servicio no disponible. Inténtelo de nuevo más tarde. Acceso restringido. No tiene permiso para ver esta página. Su sesión ha caducado. Algo salió mal.
Hindi makita ang pahina. Hindi mahanap ang hinihinging pahina. Hindi mabuksan ang aralin. May nangyaring mali. Pakisubukang muli. Walang koneksyon. Hindi magagamit ang serbisyo sa ngayon. Wala kang pahintulot na tingnan ito. Nag-expire ang sesyon.
Die Seite wurde nicht gefunden. Fehler beim Laden. Der Server antwortet nicht. Zugriff nicht erlaubt. Bitte versuchen Sie es noch einmal. Die Sitzung ist abgelaufen. Etwas ist schiefgelaufen.
La page demandée n'existe pas. Erreur du serveur. Le service ne répond pas. Accès interdit. Veuillez réessayer. La session a expiré. Une erreur est survenue.
A página não foi encontrada. Erro no servidor. Serviço indisponível. Tente novamente. Acesso negado. La pagina non esiste. Servizio non disponibile. Riprova più tardi.
お探しのページは見つかりませんでした。エラーが発生しました。サーバーに接続できません。しばらくしてから再度お試しください。アクセス権限がありません。ページを表示できません。"""


def errors() -> list[str]:
    out, k = [], 0
    for what, wrong in product(WHAT, WRONG):
        k += 1
        opener, advice = OPENERS[k % len(OPENERS)], ADVICE[(3 * k + k // 7) % len(ADVICE)]
        out.append(f"{opener}{what} {wrong}. {advice}" if k % 3 else f"{STATUS[k % len(STATUS)].split()[0]}{(': ', ' - ', ' ')[k % 9 // 3]}{what} {wrong}.")
    for k, status in enumerate(STATUS):
        out += [status, f"Error {status}", f"HTTP {status}. {ADVICE[k % len(ADVICE)]}", f"HTTP Error {status[:3]}", f"Status {status[:3]}: {status[4:].lower()}", f"{status[:3]} - {status[4:]}", f"Code {status[:3]}: {WHAT[k % len(WHAT)]} {WRONG[k % len(WRONG)]}", f"Error code {status[:3]}"]
    return out + MORE_ERRORS.split("\n")


#: Notices that scripts must be switched on.
NEEDS = "requires|needs|depends on|relies on|only works with|works best with|does not work without|will not start without|cannot be shown without|cannot run without|uses".split("|")
SCRIPT = "JavaScript|scripts|scripting|client-side scripts|active scripting|JavaScript and cookies|scripts to be enabled|JavaScript to be turned on".split("|")
READER = "This page|This site|This website|The page|This app|The application|Our site|The reader|The viewer|This quiz|This lesson|The player|The trainer|This form|The slide viewer|This content".split("|")
SWITCH = "Please enable it and reload the page.|Turn it on in your browser.|Switch it on in the settings of your browser.|Allow it for this site, then refresh.|Enable it in your browser settings.|Change your settings to continue.|Then refresh this page.|Please use a browser that supports it.|".split("|")
MORE_SCRIPTS = """Enable JavaScript to continue. Please turn on JavaScript. Turn on JavaScript before you go on. Switch on JavaScript to start. JavaScript must be enabled. You have JavaScript disabled. JavaScript is turned off in your browser. JavaScript is not enabled. You need JavaScript to see this page.
Your browser blocks scripts. Scripts are turned off. Scripts are disabled in this browser. It looks like scripts are blocked. Your browser is not running scripts. Without scripts nothing can be displayed. Allow scripts to run. Please allow scripts for this domain and reload.
Your browser does not support scripting. Your browser is out of date. Please switch to a newer browser. Your client does not run scripts. Disable your script blocker and reload this window. Loading, please wait. If this does not load, scripts are off.
noscript: scripts are needed here. Interactive content needs scripting. Scripting is required to display this interactive page. Whitelist this site in your blocker.
Debe habilitar JavaScript. Habilite JavaScript en su navegador para continuar. Por favor, habilite JavaScript. Active JavaScript y vuelva a cargar la página. Esta página necesita JavaScript. Su navegador no admite scripts.
I-enable ang JavaScript upang magpatuloy. Kailangan ng pahinang ito ang JavaScript. Naka-off ang JavaScript sa iyong browser. Paganahin ang mga script.
JavaScript muss eingeschaltet sein. Diese Seite braucht JavaScript. Bitte schalten Sie JavaScript in Ihrem Browser ein.
JavaScript doit être activé. Cette page nécessite JavaScript. Activez JavaScript dans votre navigateur.
Ative o JavaScript no seu navegador. Questa pagina richiede JavaScript. Abilita JavaScript nel browser.
JavaScriptを有効にしてからもう一度お試しください。このサイトではJavaScriptが必要です。"""


def scripts() -> list[str]:
    both = [f"{r} {n} {s}. {SWITCH[(k + k // 5) % len(SWITCH)]}" for k, (r, n, s) in enumerate(product(READER, NEEDS, SCRIPT)) if k % 3 == 0]
    return both + MORE_SCRIPTS.split("\n")


#: Texts that teach or explain such things, and exercises: natural prose.
NATURAL = """A template engine replaces a placeholder such as {{ user }} by a value before the page is sent to the reader.
In this template the mark {{ heading }} stands for what the program fills in later, and ${sum} is replaced in the same way.
In the shell a variable is written ${path}; on another system it is %TEMP%, and a header is included as <math.h> in angle brackets.
The angle brackets around <stdlib.h> and <string.h> tell the compiler where it has to look for the file.
In the example the string ${price} is a variable of the shell, and the program prints its value; ${total} and ${count} are others. Such a string stands for a value.
A list is written [1, 2, 3] and an index x[i] picks one of its items; a set is written {a, b}.
A noscript element tells visitors without scripts what they miss; a screen reader treats it as any other element of the page.
The noscript element holds what a browser shows when JavaScript is switched off; students explain why some readers browse without it.
JavaScript is a language for web pages. It runs in the browser, and a lesson compares it with other languages. Scripts change the page after it has loaded.
Typographers call dummy passages filler text; the best known begins with the words lorem ipsum, which come from a work of Cicero.
Printers have used lorem ipsum as filler for centuries because its letters are spread as in a real text.
When a server does not find what was requested it answers with status 404; status 410 tells that a page is gone for good.
Status 404 is the answer of a server when the requested page is not found, and a lesson on the web compares it with other codes of status.
Learners see how a browser tells that a page was not found or that access was denied, and what the server wrote in its log at that time.
Status 503 means that a server is overloaded, so a client waits for some seconds and sends its request again; the lesson shows how long it waits.
The status 503 tells that a server is not available for a while; students compare it with 500, an error within the server, and 403, which means that access is refused.
The message "permission denied" is shown when a user lacks a right, as the table of permission bits explains.
The first two plans are rejected, and the third is accepted. We support the claim with a table of results.
You do not have permission to enter the laboratory without a badge. The session in the afternoon was not available to visitors. The page of the book is missing.
Reading a traceback begins at its last line, which names the exception that the program raised, and goes on to the line where it happened.
An exception is handled where the program can do something about it; an error code that nobody reads is lost.
A request may time out when the network is slow, so the client waits and tries again; the lesson explains why it waits longer each time.
Fill in the blank: The ________ keeps the value until it is needed. Complete the sentence: A _______ is a sort of ______. The ____ carries the message. (fill in the blank) The ____ and the ____ are joined by a ____.
1234567890123456789012345 1 12 123 1234 12345 123456 1234567 12345678
foo_bar->baz(); if (x == 0) { return y; } int main(void) { printf("%d", n); }""".split("\n")
CLASSES = ("placeholder", "filler", "error", "scripts")

_BASE, _STIR = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Stands before a text and between texts.
_EDGE = 1


def _codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where((x >= 48) & (x <= 57), np.uint32(48), x)
    return np.where((x == 9) | (x == 13) | (x == 160), np.uint32(32), x)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all texts with edges before each, so that no n-gram reaches into another text, and the begin and size of each."""
    gap = np.full(max(ORDERS) - 1, _EDGE, np.uint32)
    parts = [_codes(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes + len(gap)) - sizes
    return np.concatenate([x for p in parts for x in (gap, p)]) if parts else np.zeros(0, np.uint32), begins, sizes


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    """The table slot of the n-gram that ends at each place, for each order."""
    out, h = [], np.zeros(len(codes), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(max(ORDERS)):
            h *= _BASE
            h[k:] ^= codes[: len(codes) - k] + np.uint32(k + 1)
            h[:k] ^= np.uint32(_EDGE + k + 1)
            m = h ^ (h >> np.uint32(15))
            m *= _STIR
            m >>= np.uint32(32 - BITS)
            out.append(m)
    return out


def _inside(begins: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which places belong to a text and not to an edge."""
    steps = np.zeros(n + 1, np.int8)
    np.add.at(steps, begins, 1)
    np.add.at(steps, begins + sizes, -1)
    return np.cumsum(steps[:-1], dtype=np.int8) > 0


def counted(texts: list[str], weight: float = 1.0) -> np.ndarray:
    """[order, slot]: the n-grams of the texts."""
    codes, begins, sizes = _joined(texts)
    keep = _inside(begins, sizes, len(codes))
    return np.stack([np.bincount(s[keep], minlength=1 << BITS) for s in _slots(codes)]) * weight


def _fit(texts: list[str]) -> np.ndarray:
    """[order, slot]: the weighted conditional probabilities of a class; a context seen once predicts with less than certainty."""
    codes, begins, sizes = _joined(texts)
    keep = _inside(begins, sizes, len(codes))
    slots = [s[keep] for s in _slots(codes)]
    counts = [np.bincount(s, minlength=1 << BITS) for s in slots]
    before = [np.full(int(keep.sum()), keep.sum(), np.float64)] + [counts[k][np.concatenate([s[:1], s[:-1]])] for k, s in enumerate(slots[:-1])]
    table = np.zeros((len(ORDERS), 1 << BITS), np.float32)
    for k, w in enumerate(WEIGHTS):
        table[k, slots[k]] = w * np.minimum(1, counts[k][slots[k]] / (before[k] + 1.0))
    return table


class Models:
    """The tables of the residue classes, [order, slot, class], and of natural prose, [order, slot] of counts."""

    def __init__(self, counts: np.ndarray):
        classes = [_fit(x) for x in (placeholders(), filler(), errors(), scripts())]
        self.tables = np.ascontiguousarray(np.stack(classes, axis=2))
        self.smooth = np.float32(max(FEW, RARE * counts[0].sum()))
        natural = counts + counted(NATURAL, EXAMPLE * float(self.smooth))
        self.total, self.natural = np.float32(natural[0].sum()), natural.astype(np.float32)

    def ratios(self, codes: np.ndarray) -> np.ndarray:
        """[place, class]: the log-likelihood ratio of each class to natural prose."""
        own = np.full((len(codes), len(CLASSES)), FLOOR, np.float32)
        base = np.full(len(codes), FLOOR, np.float32)
        before = None
        for k, (s, w) in enumerate(zip(_slots(codes), WEIGHTS)):
            own += np.take(self.tables[k], s, axis=0)
            here = np.take(self.natural[k], s)
            context = self.total if before is None else np.concatenate([here[:1], before[:-1]])
            base += np.float32(w) * np.minimum(np.float32(1), here / (context + self.smooth))
            before = here
        return np.log(own / base[:, None])

    def judged(self, texts: list[str]) -> list[tuple[int, str | None]]:
        """(characters covered by residue windows, class of the strongest) of each text; a text shorter than a window is one."""
        codes, begins, sizes = _joined(texts)
        if not sizes.sum():
            return [(0, None)] * len(texts)
        ratios = self.ratios(codes)
        ratios[~_inside(begins, sizes, len(codes))] = 0
        sums = np.zeros((len(codes) + WINDOW + 1, len(CLASSES)))
        np.cumsum(ratios, axis=0, dtype=np.float64, out=sums[1 : len(codes) + 1])
        sums[len(codes) + 1 :] = sums[len(codes)]
        at = sums[WINDOW : WINDOW + len(codes)] - sums[: len(codes)]
        # a window lies in one text; a text that is shorter is one window
        starts, full, short = np.zeros(len(codes) + 1, np.int8), sizes > 0, (sizes > 0) & (sizes < WINDOW)
        at[begins[short]] = sums[(begins + sizes)[short]] - sums[begins[short]]
        best = at.max(1)
        np.add.at(starts, begins[full], 1)
        np.add.at(starts, begins[full] + np.maximum(sizes[full] - WINDOW, 0) + 1, -1)
        best[np.cumsum(starts[:-1]) <= 0] = -np.inf
        hot = np.flatnonzero(best >= THRESHOLD)
        owner = np.searchsorted(begins, hot, side="right") - 1
        out: list[tuple[int, str | None]] = [(0, None)] * len(texts)
        for k in np.unique(owner):
            mine = hot[owner == k]
            w = min(WINDOW, int(sizes[k]))
            covered = np.minimum(np.diff(mine, append=mine[-1] + w), w).sum()
            out[k] = int(covered), CLASSES[int(at[mine[best[mine].argmax()]].argmax())]
        return out


def _together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """[begin, end) of the texts that are looked at together."""
    begin = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > TOGETHER:
            yield begin, k
            begin, held = k, 0
        held += len(t) + 4
    if begin < len(texts):
        yield begin, len(texts)


def fit(docs: DataFrame, text: str = "text") -> Models:
    """Models whose natural prose is counted over all documents: one pass, of which each task gives at most (orders * 2^BITS) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ORDERS), 1 << BITS))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _together(texts):
                counts += counted(texts[a:b])
        place = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(counts.ravel()[place])], ["place", "n"])

    rows = docs.select(F.col(text).alias("text")).where(F.length("text") > 0).mapInArrow(run, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(ORDERS) << BITS)
    counts[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    return Models(counts.reshape(len(ORDERS), -1))


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, covered): the texts that hold residue, its strongest kind, and the characters that it covers.

    Null, empty and blank texts are none. A repeated row is judged each time; other columns are not read; texts of any length are
    scored whole. An empty table gives no row.
    """
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, text))  # of a fixed size: 5 classes x 5 orders x 2^BITS slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models.value
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            judged = [j for a, b in _together(texts) for j in m.judged(texts[a:b])]
            cols = list(zip(*[(k, kind, covered) for k, (covered, kind) in zip(keys, judged) if covered >= COVER])) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["doc_id", "kind", "covered"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"(?U)\S")).mapInArrow(run, "doc_id bigint, kind string, covered int")
