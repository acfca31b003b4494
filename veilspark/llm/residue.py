"""Template residue, filler and error pages in a corpus, by character n-gram models.

Models of order :data:`ORDER` over 32 character classes are fitted for filler (dummy Latin, and phrases),
for error and script notices (from the seed texts below) and for natural prose (from all distinct texts
of the corpus, each counted once however many rows carry it, with whatever digits). Prose is fitted twice, so that pages which
fill a corpus are not learned as its prose: the first fit leaves out the windows that read like residue
against the seed prose alone, the second those that do against the first. A document is cut
at lines and sentences, and every such window gets the likelihood ratio of the better residue model
against prose, by one table look-up a character. Where residue windows cover at least
:data:`COVERAGE` of the running text (captions have none), filler or a notice stands for the ruling.
Unfilled placeholders are localised by their delimiters and a model of field names, and one suffices.
What stands in quotation marks is quoted or discussed, not residue; blackenings read like prose.

Defined results: NULL text has no case, empty or blank text neither; repeated rows count once; texts
are scanned whole. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.session import written

ORDER = 4
#: Fits of the prose model; each leaves out what is residue under the one before.
FITS = 2
#: Grams that a task collects before it adds them to its counters.
PENDING = 1 << 20
#: Least mean log ratio a character for a window to be residue.
RATIO = 0.25
COVERAGE = 0.5
LEAST = 20

# Seed texts (fixed values): filler ...
LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
vitae sapien quam ornare lectus arcu cursus viverra justo nibh porta fermentum mollis tempor nostra velit magna pellentesque habitant morbi tristique senectus et netus malesuada fames ac turpis egestas vestibulum tortor quam feugiat vitae ultricies eget tempor sit amet ante donec eu libero aenean ultricies mi"""
FILLER = """Insert the reasons here. Put your own text here. Here comes the text. Enter the headnote. Text for the headnote. Headnote text goes here. The text of this paragraph goes in here. Wording of the judgment goes here. To be filled in later. To be done. To be drafted. To be written by the clerk. To be completed later. To follow. TBD. TODO. TBA. Draft. Mock paragraph. Test paragraph. Dummy content. Sample content. Placeholder paragraph. Stand-in text. Blah blah blah. testing testing. test test test. test 123 test. Test. abc abc abc. foo. bar. baz. foo bar baz. foo bar qux quux corge. bar foo bar.
asdf. asdf asdf asdf. asdfgh jkl. jkl jkl jkjk. hjkl hjkl. qwer. qwer qwer. qwerty uiop. qwertz uiop. yxcv yxcv. xxx xxxx xxxxx. yyy yyyy. zzz zzzz. aaa bbb ccc. xxxx asdf zzz qwer.
These words only fill the space and carry no meaning. This copy is here to show how the layout will look and will be replaced by the real text before release. The paragraph stands in for a text that is not written yet. Words without sense, put here for testing the print. Nonsense, take it out before publishing. This text means nothing; it is a sample for checking the template and it will be removed. It says nothing and is there for the layout only.
Das ist nur ein Fülltext ohne Bedeutung. Hier wird später der richtige Text stehen. Dieser Platzhalter zeigt das Layout und wird noch ersetzt. Blindtext, Mustertext und Beispieltext für die Gestaltung. Der Inhalt folgt. Ein Probetext für den Satz, er hat nichts zu sagen und fällt vor dem Druck weg.
Ceci est un faux texte pour montrer la mise en page. Un texte fictif sans aucun sens, à remplacer plus tard. Paragraphe d'essai qui sera supprimé. Contenu provisoire du gabarit. Le texte définitif viendra ici. Exemple de texte pour tester l'impression avant la publication.
Este es un texto ficticio para mostrar el diseño. Texto de prueba sin sentido que se sustituirá después. Párrafo de muestra para la maquetación, sin contenido real. Contenido provisional, se eliminará antes de publicar. Aquí irá el texto definitivo. Ejemplo de relleno para probar la impresión."""
# ... and notices of pages that failed or ask for scripts, with what stands around them, beside the status lines of the
# HTTP standard (:func:`_statuses`).
NOTICES = """Sorry, we cannot find that page. It may have been moved, renamed or deleted. The page could not be found. Check the address and try once more. The link you followed is broken. This file could not be loaded. The requested document is not available right now and cannot be displayed. Our server did not answer in time. The file behind that address is gone. The database is offline. We are carrying out maintenance; the service will be back shortly. The viewer ran into a problem it did not expect. Something went wrong while loading the record. An error has occurred and was reported to our team. Our search service could not be reached. Our site is closed for maintenance, kindly come back later or tomorrow. If the problem persists, contact the help desk and quote the request id; support will see to it. Your login has timed out; sign in to continue. Your session ended. You are not authorised to open this record. You have no permission to view this file. Access to this resource was denied. Too many requests came from your network, wait a moment and try again. Please try later. Go back to the start page or to the list of results. Reference number 1234567. Request id 1234567.
JavaScript is switched off in your browser. Turn JavaScript on to use this site. You need to enable JavaScript to run this app. This application needs JavaScript to work. To read this page, allow scripts. Scripts must be switched on for the viewer to run. Please allow scripts and cookies, then reload this page. Enable scripts in the settings of your browser before continuing. A content blocker stops this portal from loading; please turn it off. We are checking that your browser is secure. The check takes a few moments only. Solve the task to show that you are human and not a robot. Active content was blocked, therefore the document viewer did not start. Your browser does not run the scripts that this portal needs.
Die Seite konnte leider nicht gefunden werden. Das angeforderte Dokument wurde verschoben oder gelöscht. Beim Laden des Dokuments ist ein Fehler aufgetreten. Der Zugriff auf diese Seite wurde verweigert. Ihre Anmeldung ist abgelaufen, bitte melden Sie sich wieder an. Der Dienst ist momentan nicht erreichbar, versuchen Sie es später noch einmal. Für diese Anwendung muss JavaScript aktiviert sein. Bitte aktivieren Sie Skripte im Browser und laden Sie diese Seite erneut. Ihr Browser blockiert aktive Inhalte. Zurück zur Startseite. Suche. Anmelden.
La page que vous cherchez est introuvable. Ce document a été déplacé ou supprimé. La page n'existe pas. Le service est momentanément indisponible, merci de réessayer plus tard. Une erreur est survenue pendant le chargement. Accès refusé. Vous n'avez pas accès à cette page. Votre session est terminée, identifiez-vous à nouveau. JavaScript doit être activé dans votre navigateur pour afficher ce site. Veuillez autoriser les scripts puis recharger la page. Les scripts nécessaires sont bloqués par le navigateur. Accueil. Recherche. Se connecter.
No se ha encontrado la página que busca. La página no existe. El documento se ha trasladado o eliminado. El servicio no responde en estos momentos, inténtelo más tarde. El sistema no está disponible. Se ha producido un error al cargar la página. Acceso denegado. No tiene permiso para ver este documento. La sesión ha caducado, vuelva a iniciarla. Para usar este sitio se requiere activar JavaScript en el navegador. Active los scripts y cargue de nuevo la página. Su navegador bloquea los scripts. Inicio. Buscar. Entrar.
Home | Search. Home. Decisions. Start page. Search the site. Contact us. Log in. Login. Register. Sign up. My account. Site map. Help. Print. Share. Accessibility. Legal notice. Cookies. Cookie preferences. Privacy notice. Privacy policy. Terms and conditions. Terms of use. Copyright. Menu. Next. Previous. Jump to the main content. Skip navigation. Back to the list. Results. Startseite > Suche > Treffer."""
#: Natural prose to begin with; it holds nothing of the corpus.
PROSE = """The court has heard the parties and considered the evidence before it, and finds that the claim was brought in time. The contract was signed by both sides and the price was paid in full. The appeal is therefore dismissed, and the costs are to be borne by the appellant. Nothing in the record suggests that the notice did not reach the addressee.
Das Gericht hat die Parteien angehört und die Beweise gewürdigt. Die Klage wird abgewiesen, die Kosten trägt die Klägerin. Le tribunal a entendu les parties et examiné les pièces du dossier. Le pourvoi est rejeté et les dépens sont mis à la charge de la requérante. El tribunal ha oído a las partes y examinado las pruebas. Se desestima el recurso y se imponen las costas a la parte recurrente."""
FIELDS = """name first_name last_name full_name surname title party party_a party_b plaintiff claimant defendant respondent appellant applicant lawyer counsel judge presiding_judge clerk court court_name chamber seat case case_no case_number docket docket_no file_no registry reference date decision_date hearing_date date_of_birth day month year place city street address zip country amount sum currency interest_rate costs fee subject headnote summary facts reasons operative_part citation cited_case court.name judge.name party.name amount_in_words date_of_hearing signature page number version customer customer_name company invoice_no order_id email phone user_name field value text
Name Vorname Partei Kläger Klägerin Beklagte Beklagter Richter Gericht Aktenzeichen Datum Ort Betrag Anschrift nom prénom partie demandeur défendeur juge tribunal numéro date_audience montant adresse nombre apellido parte actor demandado juez juzgado número fecha importe dirección NAME PARTY JUDGE DATE COURT CASE_NO AMOUNT"""
#: Letters as mathematicians name them: what stands in braces or between dollar signs in formulas, never a field.
SYMBOLS = frozenset("alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi varphi chi psi omega infty sum prod int sqrt frac cdot times leq geq neq mathbb mathcal mathrm".split())
#: Least mean log ratio of field names against prose for a name between marks that texts use otherwise too, and for one
#: between marks of templates only.
WEAK, STRONG = -1.0, -3.0

_ID = r"[A-Za-zÀ-ÿ][\w.À-ÿ]*(?:[ _][\w.À-ÿ]+){0,5}"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s?(?P<a>{_ID}|\d{{1,2}})\s?\}}\}}|\{{%-?\s?(?P<b>{_ID})\s?-?%\}}|[$#]\{{\s?(?P<c>{_ID})\s?\}}|(?<![{{$#%])\{{(?P<d>[A-Za-z][\w.]+|\d{{1,2}})\}}|<%=?-?\s?(?P<e>{_ID})\s?-?%>|<<\s?(?P<f>{_ID})\s?>>"
    rf"|<(?:insert|enter|your|add) (?P<g>{_ID})>|«(?P<h>[A-Za-z][\w.]*)»|%\((?P<i>{_ID})\)s|(?<![\w%])%(?P<j>[A-Za-z][\w.]+)%(?![\w%])|(?<![\w$])\$(?P<k>[A-Za-z][\w.]+)\$(?![\w$])|(?<!\w)__(?P<l>[A-Za-z][A-Za-z0-9_.]*?)__(?!\w)|@@(?P<m>{_ID})@@"
    rf"|\[\[\s?(?P<n>{_ID})\s?\]\]|\[(?:INSERT|Insert|ENTER|Enter|ADD|FILL IN|TO BE COMPLETED:?) (?P<o>{_ID})\]|\[(?P<p>{_ID}) (?:EINFÜGEN|einfügen|EINSETZEN|einsetzen)\]|\[(?:à compléter|À COMPLÉTER|por completar|A COMPLETAR|a completar) ?:? ?(?P<q>{_ID})\]|\((?:enter|insert|ENTER|INSERT) (?P<r>{_ID}) here\)",
    re.IGNORECASE,
)
#: The groups whose marks stand in other texts too: braces, guillemets, percent and dollar signs, underscores.
_WEAK_MARKS = frozenset("dhjkl")
# Each search begins with one set of characters: the engine skips to these instead of trying every position.
#: What a placeholder must begin with, or hold; most texts have none and are not searched further.
_ANY_MARK = re.compile(r"[{«$@%<_\[(](?:(?<=[{«$@])|(?<=%)[(A-Za-z]|(?<=<)[<%A-Za-z]|(?<=_)_|(?<=\[)(?:\[|(?i:insert|enter|add|fill|to be|à|por|a ))|(?<=\()(?i:enter|insert) )")
_GERMAN_MARK = re.compile(r"[eE](?i:infügen|insetzen)")
_QUOTED = re.compile(r"[“„\"‘»](?:(?<=“)[^”]{0,600}”|(?<=„)[^“”]{0,600}[“”]|(?<=\")[^\"\n]{1,300}\"|(?<=‘)[^’\n]{2,300}’(?!\w)|(?<=»)(?<!\w»)[^«»\n]{2,300}«(?!\w))")
#: A boundary with the mark before it, which stays with its sentence.
_CUT = re.compile(r"[\n.!?;:](?:(?<=\n)\n*|(?<=[.!?;:])(?:\n+|\s+))")

_DIGIT = re.compile("[1-9]")

# 32 classes: letters 1-26, blank 0, digit 27, end of sentence 28, bar and dash 29, other marks 30, other letters 31
_CLASS = np.full(256, 30, dtype=np.uint32)
for _c in range(26):
    _CLASS[97 + _c] = _CLASS[65 + _c] = 1 + _c
for _c in b" \t\r\n":
    _CLASS[_c] = 0
for _c in b"0123456789":
    _CLASS[_c] = 27
for _c in b".!?":
    _CLASS[_c] = 28
for _c in b"|-/>":
    _CLASS[_c] = 29
_CLASS[128:] = 31
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_LOWER[195] = True  # the first byte of accented Latin letters

_LETTER = _LOWER.copy()
_LETTER[65:91] = True


def _grams(raw: bytes, order: int) -> np.ndarray:
    c = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    n = len(c) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    out = np.zeros(n, dtype=np.uint32)
    for k in range(order):
        out = (out << np.uint32(5)) | c[k : k + n]
    return out


def counts_of(texts: Iterable[str]) -> np.ndarray:
    """How often every gram stands in the texts."""
    raw = b"   " + b"   ".join(t.encode("utf-8", "replace") for t in texts)
    return np.bincount(_grams(raw, ORDER), minlength=32**ORDER)


def model(counts: np.ndarray, prior: float = 0.5) -> np.ndarray:
    """Log probability of every last character given those before it, smoothed by the shorter contexts."""
    orders = [counts.astype(np.float64)]
    while orders[0].size > 32:
        orders.insert(0, orders[0].reshape(32, -1).sum(axis=0))
    below = np.full(32, 1 / 32)
    for k, order in enumerate(orders, 1):
        seen = order.reshape(-1, 32)
        total = seen.sum(axis=1, keepdims=True)
        base = np.tile(below.reshape(-1, 32), (32**k // below.size, 1)) if k > 1 else below.reshape(1, 32)
        weight = prior * np.maximum(1, (seen > 0).sum(axis=1, keepdims=True))
        below = ((seen + weight * base) / (total + weight)).reshape(-1)
    return np.log(below).astype(np.float32)


def fit(texts: Iterable[str]) -> np.ndarray:
    return model(counts_of(texts))


def _lorem_seed() -> list[str]:
    words, out = LOREM.split(), [LOREM]
    # other orders of the same words, so that the model learns words rather than one passage
    for step in (7, 11, 13, 17, 19, 23):
        line = words[::step] + words[1::step]
        out.append(" ".join(line).capitalize() + ".")
        out.append(". ".join(" ".join(line[i : i + 7]).capitalize() for i in range(0, len(line), 7)) + ".")
    return out


def _segments(text: str) -> tuple[list[tuple[int, int]], bytes, np.ndarray, np.ndarray]:
    """Segments of a text, their padded bytes in one string, and where each begins and ends there."""
    cuts, at = [], 0
    for m in _CUT.finditer(text):
        start = m.start()
        if text[start] != "\n":
            start += 1
        if start > at:
            cuts.append((at, start))
        at = m.end()
    if at < len(text):
        cuts.append((at, len(text)))
    parts = [f"   {text[a:b]} ".encode("utf-8", "replace") for a, b in cuts]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(lengths)
    return cuts, b"".join(parts), ends - lengths, ends


def _statuses() -> list[str]:
    """The status lines of the HTTP standard for requests that failed, in the ways pages show them."""
    lines = []
    for status in HTTPStatus:
        if status >= 400:
            of = (status.value, status.phrase)
            lines.append(". ".join(form % of for form in ("%d %s", "Error %d: %s", "HTTP %d - %s", "HTTP error %d (%s)", "%d | %s", "Fehler %d (%s)", "Fehler %d: %s", "Erreur %d %s", "Erreur %d: %s", "Error %d (%s)", "%d - %s", "%d: %s")))
    return lines


#: What fails on a page, and how, by language: every thing with every failure is a sentence of such pages.
FAILURES = (
    ("The {}", ("page", "document", "file", "record", "service", "server", "link", "decision", "database", "portal", "viewer"), ("could not be found", "could not be loaded", "cannot be shown", "is not available", "did not respond", "was not found", "no longer exists", "failed to open")),
    ("This {}", ("page", "document", "file", "record", "service", "link", "site", "portal"), ("could not be found", "could not be opened", "cannot be displayed", "does not exist", "did not answer", "is not available", "needs scripts", "requires a browser with scripts")),
    ("{}", ("Die Seite", "Das Dokument", "Die Datei", "Der Dienst", "Der Server"), ("wurde nicht gefunden", "konnte nicht geöffnet werden", "ist nicht verfügbar", "antwortet nicht", "kann nicht angezeigt werden")),
    ("{}", ("La page", "Le document", "Le fichier", "Le service", "Le serveur"), ("est introuvable", "n'a pas pu être chargé", "n'est pas disponible", "ne répond pas", "ne peut pas être affiché")),
    ("{}", ("La página", "El documento", "El archivo", "El servicio", "El servidor"), ("no se ha encontrado", "no se puede mostrar", "no está disponible", "no responde", "no se ha podido cargar")),
)


def _failures() -> list[str]:
    return [f"{frame.format(thing)} {how}." for frame, things, ways in FAILURES for thing in things for how in ways]


@lru_cache(1)
def _residue() -> tuple[np.ndarray, ...]:
    """The models of filler and notices, and that of field names."""
    return fit(_lorem_seed()), fit([FILLER] * 3), fit([NOTICES] * 3 + _statuses() + _failures() * 2), fit([FIELDS] * 10)


class Models:
    """The fitted ratios. ``texts`` are for tests and small corpora; :func:`fitted` learns from a table."""

    def __init__(self, texts: Iterable[str] = ()) -> None:
        self.learn(np.zeros(32**ORDER, dtype=np.int64))
        distinct = list(dict.fromkeys(_DIGIT.sub("0", t) for t in texts if t))
        for _ in range(FITS if distinct else 0):
            self.learn(self.prose_counts(distinct))

    def learn(self, counts: np.ndarray) -> None:
        """Take the seed prose with these counts as the model of prose."""
        prose = model(counts_of([PROSE]) + counts)
        *residue, names = _residue()
        # one look-up gives all ratios
        self.ratio = np.stack([r - prose for r in residue], axis=1)
        self.named = names - prose

    def prose_counts(self, texts: Iterable[str]) -> np.ndarray:
        """The gram counts of all windows that do not read like residue under the present model."""
        total = np.zeros(32**ORDER, dtype=np.int64)
        pending, held = [], 0
        for text in texts:
            cuts, raw, starts, ends = _segments(_QUOTED.sub(" ", text))
            if not cuts:
                continue
            ratios, grams = self._scores(raw, starts, ends)
            keep = np.repeat(ratios < RATIO, ends - starts)
            for k in range(3):
                keep[starts + k] = False
            pending.append(grams[keep[ORDER - 1 :]])
            held += len(pending[-1])
            if held >= PENDING:
                total += np.bincount(np.concatenate(pending), minlength=total.size)
                pending, held = [], 0
        if pending:
            total += np.bincount(np.concatenate(pending), minlength=total.size)
        return total

    def windows(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Segments of a text, the better mean ratio of each, and its number of small-letter words."""
        cuts, raw, starts, ends = _segments(text)
        if not cuts:
            return [], np.zeros(0), np.zeros(0)
        ratios, _ = self._scores(raw, starts, ends)
        b = np.frombuffer(raw, dtype=np.uint8)
        begins = np.zeros(len(b), dtype=np.int32)
        letters = _LOWER
        if _LOWER[b].sum() < 0.2 * _LETTER[b].sum():  # a text in capitals: its words have no small letters
            letters = _LETTER
        begins[1:] = letters[b[1:]] & (_CLASS[b[:-1]] == 0)
        return cuts, ratios, np.add.reduceat(begins, starts)

    def _scores(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The better mean ratio of each segment, and the grams of ``raw``."""
        grams = _grams(raw, ORDER)
        values = np.zeros((len(raw), self.ratio.shape[1]), dtype=np.float32)
        np.take(self.ratio, grams, axis=0, out=values[ORDER - 1 :], mode="clip")
        # the gram that reaches back over a segment's beginning belongs to no segment: pads hide it
        for k in range(3):
            values[starts + k] = 0
        sums = np.add.reduceat(values, starts, axis=0)
        return (sums / (ends - starts - 3).astype(np.float32)[:, None]).max(axis=1), grams

    def placeholder(self, text: str) -> bool:
        """Whether an unfilled placeholder stands outside quotation marks (already masked)."""
        if not _ANY_MARK.search(text) and not _GERMAN_MARK.search(text):
            return False
        return any(self.is_field(m[m.lastgroup], m.lastgroup in _WEAK_MARKS) for m in PLACEHOLDER.finditer(text))

    def is_field(self, name: str, weak: bool) -> bool:
        """Whether a name between marks is that of a form's field, by its characters."""
        if name.isdigit():
            return True
        if len(name) == 1 or name.lower() in SYMBOLS or not any(c.isalpha() for c in name):
            return False
        if "_" in name.strip("_"):  # no language joins words so
            return True
        raw = b"   " + name.encode("utf-8", "replace") + b" "
        return float(self.named[_grams(raw, ORDER)].mean()) > (WEAK if weak else STRONG)

    def coverage(self, masked: str) -> tuple[float, int]:
        """Share of the running text that residue windows cover, and their characters."""
        segments, ratios, small = self.windows(masked)
        residue = prose = 0
        for (a, b), r, n in zip(segments, ratios.tolist(), small.tolist()):
            if r >= RATIO and b - a >= 4:
                residue += b - a
            elif n >= 4:
                prose += b - a
        return (residue / (residue + prose) if residue else 0.0), residue

    def is_residue(self, text: str | None) -> bool:
        if not text or text.isspace():
            return False
        masked = _QUOTED.sub(" ", text)
        if self.placeholder(masked):
            return True
        share, chars = self.coverage(masked)
        return chars >= LEAST and share >= COVERAGE


def fitted(documents: DataFrame) -> Models:
    """The models with the prose of all distinct texts.

    Every task sums the counters of its texts; what is shuffled and sent to the driver are sums by gram,
    at most 32 ** ORDER rows, whatever the size of the corpus.
    """
    # a digit is a digit to the models: pages that differ in a number only are one text
    texts = documents.where("text <> ''").select(F.regexp_replace("text", "[1-9]", "0").alias("text")).distinct()
    models = Models()
    with written(texts) as once:
        for _ in range(FITS):
            models.learn(_counted(once, models))
    return models


def _counted(texts: DataFrame, models: Models) -> np.ndarray:
    """The gram counts of all windows of ``texts`` that do not read like residue under these models."""
    current = texts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = current.value.prose_counts(t for batch in batches for t in batch.column(0).to_pylist())
        (grams,) = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(counts[grams], pa.int64())], names=["gram", "n"])

    sums = texts.mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(32**ORDER, dtype=np.int64)
    counts[sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    current.unpersist()
    return counts


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every document to exclude."""
    models = documents.sparkSession.sparkContext.broadcast(fitted(documents))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = models.value
        for batch in batches:
            ids = [d for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if look.is_residue(t)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["doc_id"])

    return documents.where("text is not null and text <> ''").select("doc_id", "text").mapInArrow(run, "doc_id bigint").distinct()
