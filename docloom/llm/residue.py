"""Problem 2: pages that hold an error message, a scripts notice, filler or an unfilled template instead of content.

Character n-gram models are fitted: one for each kind of residue on the general wording below, one for natural prose and one for the furniture of pages on
the corpus' own text: every distinct block of long bodies, and every one outside bodies.  The wording of a site's messages isn't
known beforehand, so the models of residue learn from the corpus: all blocks of short bodies that they recognise are added to their texts and
they are fitted again, ROUNDS times.  A model is counts by slot, so tasks count and only sums come to the driver, of one size whatever the corpus has.

Windows of a text in which a residue model beats those of prose and furniture by MARGIN are residue; the share of a text's
characters in such windows is its coverage.  Windows in which prose beats residue by REAL_MARGIN are real.  A page is a case if it has residue, a
block covered by COVERAGE or more, and if its body but headings has fewer than REAL_CHARS real characters.  The body is that of the page's wrapper (see
``main_body``); a page without one is judged by all its blocks but links, constants of the template and what containers of the site hold.

Null and empty pages, and pages without text, are no cases.  Blocks are judged until the body is known to be real.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrowmap import chunks_by_chars
from docloom.functions.markup import BLANK, HEADINGS
from docloom.llm.main_body import FIELDS, FURNITURE_PAGES, FURNITURE_RATIO, Unit, main_units, map_pages, plain, survey, units_of, wrappers
from docloom.session import checkpointed, dropped

#: General wording that the models of residue are fitted on, by kind.
ERRORS = """
HTTP error 404: the document was not found. The page could not be found. Sorry, but this page cannot be found. We looked everywhere but couldn't find that page.
The resource you requested could not be located. The file may have been removed, renamed, or is temporarily unavailable. This link seems to be broken or outdated.
It looks like nothing was found at this location. The article you are trying to reach has been deleted. The content has been moved to another address.
The web address you entered is not a functioning page on our site. Please check the URL for typing mistakes. Use the search box or return to the home page.
An internal server error has occurred while processing your request. The server encountered an unexpected condition and was unable to complete your request.
Sorry, something went wrong on our end. Oh no, something broke. We are having technical difficulties. Our team has been notified and is working to fix the problem.
An unknown error has happened. An unhandled exception occurred. The application failed to load. Could not load the page. Failed to fetch the document. Please reload this page or try later.
The service is temporarily unavailable. The server is currently overloaded. The gateway did not receive a timely response from the upstream host. The connection has timed out.
The website is undergoing scheduled maintenance. We are performing maintenance on our systems. We should be back shortly. The site will return in a few hours. Thank you for your patience.
Unable to connect to the database server. The backend is not reachable. A network error prevented the page from being displayed. The host did not reply in time.
You don't have access to this page. You are not allowed to see this content. Your account doesn't have sufficient privileges. Ask the space owner to grant you access. Viewing is restricted.
You must be signed in to see this page. Please sign in with your account. Authentication is required. Your login has expired, please authenticate again. You have been logged out due to inactivity.
Your request has been blocked for security reasons. You have been blocked. Suspicious activity was detected from your address. The firewall rejected this request.
You have made too many requests, wait a moment and try again. Request limit exceeded. Quota reached. You are being rate limited. Retry in a few seconds.
This page has been archived and can no longer be viewed. This workspace has been closed. The space no longer exists or is hidden. The content was permanently removed.
If the problem persists, contact support and quote the reference number below. Please get in touch with the help desk. Report this problem to the site administrator. Incident id 0000. Request id 0000. Error code 0000. Status 500.
The macro could not be rendered because of an error. Failed to render this macro. Unknown macro. Error while loading the extension. Cannot render the content of the page.
java.lang.RuntimeException: could not execute the query at line 0. Caused by: java.io.IOException. NullPointerException at com.example.web.Handler. Unhandled exception in thread. Traceback, most recent call last. ValueError: invalid literal. TypeError: undefined is not a function. Fatal error: uncaught exception. Stack trace follows. Segmentation fault. Warning: mysql connect failed.
Go to the start page. Back to the homepage. Return to the previous page. Try again. Retry now. Log in. Sign in to continue browsing.
Error 404: no se pudo encontrar la página. No hemos podido encontrar la página que busca. El recurso solicitado no está disponible. La dirección es incorrecta o el contenido fue eliminado. El enlace está roto o ha caducado. La página que intenta abrir ya no existe. Revise la dirección e intente otra vez.
Ha ocurrido un error interno en el servidor. Algo salió mal. Lo sentimos, ocurrió un problema al cargar la página. El servicio no está disponible en este momento. El sitio está en mantenimiento y volverá pronto. Intente de nuevo dentro de unos minutos. El servidor tardó demasiado en responder.
No tiene permiso para acceder a este recurso. El acceso está restringido. Debe iniciar sesión para ver esta página. Su sesión expiró, identifíquese de nuevo. Ha superado el límite de peticiones. Si el problema continúa, póngase en contacto con el administrador. Regresar a la página principal.
Fehler 404: Die Seite konnte nicht gefunden werden. Die gesuchte Seite ist nicht verfügbar. Die Adresse ist falsch oder der Inhalt wurde gelöscht. Der Link ist veraltet. Bitte prüfen Sie die Adresse.
Es ist ein interner Serverfehler aufgetreten. Etwas ist schiefgelaufen. Beim Laden der Seite ist ein Problem aufgetreten. Der Dienst ist vorübergehend nicht verfügbar. Die Seite wird gerade gewartet. Versuchen Sie es in einigen Minuten noch einmal. Der Server hat nicht rechtzeitig geantwortet. Unerwarteter Fehler.
Sie haben keine Berechtigung, diese Seite anzusehen. Der Zugang ist gesperrt. Sie müssen sich anmelden, um diese Seite zu sehen. Die Sitzung ist abgelaufen. Zu viele Anfragen. Wenden Sie sich an den Administrator, wenn das Problem weiter besteht. Zurück zur Startseite.
Erro 404: a página não foi encontrada. Não foi possível encontrar a página que procura. O recurso pedido não está disponível. O endereço está errado ou o conteúdo foi removido. A ligação expirou. Verifique o endereço e tente novamente.
Ocorreu um erro interno no servidor. Algo deu errado. Houve um problema ao carregar a página. O serviço está temporariamente fora do ar. O site está em manutenção e voltará em breve. Tente de novo dentro de alguns minutos. O servidor não respondeu a tempo. Erro inesperado.
Você não tem permissão para ver esta página. O acesso foi bloqueado. É preciso entrar na sua conta para continuar. A sessão terminou, entre novamente. Limite de pedidos excedido. Se o problema continuar, fale com o administrador. Voltar à página inicial.
"""
SCRIPTS = """
JavaScript must be enabled in order to view this page. JavaScript is turned off in your web browser. It seems that your browser has JavaScript disabled. Your browser does not support scripts.
To view this content, activate JavaScript in your browser settings and refresh the page. For full functionality of this site it is necessary to enable JavaScript. We're sorry but this app doesn't work properly without JavaScript enabled.
This page needs scripting to be switched on. The viewer could not be started because scripts are not allowed. Turn on scripting, then reload. Allow scripts and cookies for this domain. Your browser blocked our scripts.
Please wait while the page is loading. The content is loading. Loading the application. If the page does not appear, check that scripts are enabled. Verifying that you are human. Please wait while we check your browser. This may take a few seconds.
Please update your browser or enable scripts to read the article. Some features are unavailable when JavaScript is off. Without JavaScript the menu and the search cannot be shown.
Es necesario habilitar JavaScript para usar esta página. Su navegador no admite JavaScript o está desactivado. Por favor, habilite JavaScript y vuelva a cargar la página. Cargando la aplicación, espere un momento. Sin JavaScript no se puede mostrar el contenido. Permita los scripts de este sitio para leer el artículo.
Um diese Seite zu nutzen, muss JavaScript eingeschaltet sein. Ihr Browser unterstützt kein JavaScript oder es ist abgeschaltet. Schalten Sie JavaScript ein und laden Sie die Seite neu. Die Anwendung wird geladen, bitte warten. Ohne JavaScript kann der Inhalt nicht angezeigt werden. Erlauben Sie Skripte für diese Seite.
É necessário habilitar o JavaScript para usar esta página. O seu navegador não suporta JavaScript ou está desligado. Por favor, ligue o JavaScript e recarregue a página. A carregar a aplicação, aguarde um momento. Sem JavaScript o conteúdo não pode ser mostrado. Permita os scripts deste site.
"""
#: The stock of words of filler text in Latin.
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat
duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
a ac accumsan aenean aliquam aliquet ante arcu at auctor augue bibendum blandit condimentum congue convallis cras curabitur cursus dapibus diam dictum dignissim donec dui egestas eget eleifend elementum erat eros etiam euismod
facilisis fames faucibus felis fermentum feugiat fringilla fusce gravida hendrerit iaculis imperdiet integer interdum justo lacinia lacus laoreet lectus leo libero ligula lobortis luctus maecenas malesuada massa mattis mauris metus
molestie morbi nam nec neque nibh nisl nullam nunc odio orci ornare pellentesque pharetra phasellus placerat porta porttitor posuere praesent pretium proin pulvinar purus quam quisque rhoncus risus rutrum sagittis sapien scelerisque sem semper
sodales sollicitudin suscipit suspendisse tellus tempus tincidunt tortor tristique turpis ultrices ultricies urna varius vehicula vel venenatis vestibulum vitae vivamus viverra volutpat vulputate
"""
FILLER = """
This is some sample text that shows the layout. This paragraph is only a placeholder. Here goes your text. Your text here. Add your content here. Start writing your content. Type something. Enter your text in this box. Write a short introduction. Insert your paragraph here. This block is left empty on purpose. Use this space to tell your readers about the topic.
This is a demo page. Dummy content for testing. Test content, please ignore. Example text. Filler text for the design. Replace this text with real content before publishing. The final copy will follow. Content will be added soon. More information to come. Under construction. To be written. To be completed. Work in progress. Watch this space. Nothing here yet. Click to add text. Edit this paragraph. Text goes here. Heading goes here. Image caption goes here.
blah blah blah blah. bla bla bla. asdf asdf asdf. qwerty qwerty. asdfgh jkl. qwertyuiop. foo bar baz qux. abc abc abc. xxx xxx xxxx xxxxx. aaa bbb ccc. test test test. testing one two three. text text text. hello world. sample sample. word word word. yyy zzz. ---- ----. 123 123. The quick brown fox jumps over the lazy dog.
Este es un texto de relleno. Texto provisional. Escriba aquí su contenido. Aquí va el texto. Reemplace este párrafo por el contenido real. Texto de muestra para la maquetación. Contenido pendiente. Próximamente. En construcción. Página de prueba. Haga clic para editar este texto. Párrafo de relleno. Añada una descripción.
Dies ist ein Blindtext. Hier steht später der Text. Bitte Text eingeben. Ersetzen Sie diesen Absatz durch den eigentlichen Inhalt. Mustertext für das Layout. Inhalt folgt. In Vorbereitung. Im Aufbau. Testseite. Klicken Sie hier, um den Text zu bearbeiten. Fülltext.
Este é um texto de preenchimento. Texto provisório. Escreva aqui o seu conteúdo. Aqui vai o texto. Troque este parágrafo pelo conteúdo real. Texto de amostra para o layout. Conteúdo pendente. Em breve. Em construção. Página de teste. Clique para editar este texto.
"""
#: What templates name, how their languages mark a place to be filled, and how people do.
TEMPLATE_NAMES = "title name date author description status version summary body content text page.title user.name product customer company email address phone url link date_from step section header footer subject item value id label comment notes intro topic team project".split()
TEMPLATE_MARKS = ["{{ %s }}", "{{%s}}", "{%s}", "{{{%s}}}", "{%% %s %%}", "${%s}", "#{%s}", "$%s$", "%%%s%%", "%%%%%s%%%%", "##%s##", "@@%s@@", "@{%s}", "[[%s]]", "[%s]", "<%s>", "<%%= %s %%>", "__%s__", "{{ item.%s }}", "{{ %s | default }}"]
TEMPLATE_WORDS = ["[Enter %s]", "[enter the %s here]", "[Insert %s]", "<insert %s here>", "<your %s>", "[your %s here]", "(%s to be defined)", "TODO write the %s", "TODO: add %s", "TBD: %s", "FIXME: %s missing", "Add the %s here", "Enter the %s in this field", "Replace with the %s", "Explain the %s here", "Provide a %s", "List the %s", "Fill in the %s", "[Introduzca %s]", "Indique aquí %s", "Complete %s", "[%s eintragen]", "%s hier eintragen", "Ergänzen Sie %s", "[Preencher %s]", "Preencha aqui %s", "Indique %s aqui"]


#: General wording of the furniture of pages, which models of residue are held against besides the corpus' own.
FURNITURE = """
Did you find this page useful? Was this article helpful to you? Was this information helpful? Rate this page. Give feedback on this page. Send feedback. Report an issue with this page. Report an error on this page. Suggest an edit. Edit this page. Found a problem with this page? Tell us.
Share this article. Share on social media. Copy the link to this page. Print this page. Save as PDF. Add to favourites. Watch this space for changes. Watch page. Subscribe to this page. 12 people found this useful. 12 people liked this. 12 likes. Be the first to like this. 12 comments. Leave a comment.
Last updated on 12 May 2020. Last modified by the author. Last edited by an editor. Last reviewed 12 days ago. Edited 12 days ago by the team. The editor updated this page 12 days ago. Created by the documentation team. 12 minute read. Reading time about 12 minutes. Version history.
Powered by the wiki. Powered by the portal. Generated by the documentation tool. Generated on day 12 by the export. Exported from the space on 12 May. Document generated by the export tool. Document exported on day 12. Printed from the portal.
Copyright 2020 by the company. © 2020 The company documentation team. All rights reserved. All trademarks are the property of their owners. All product and company names are trademarks of their holders. Product names are registered marks.
Terms of service. Terms and conditions of use. Terms and privacy. Privacy policy. Privacy and cookies. Legal notice. Imprint. Imprint and terms. Accessibility. Contact us. About us. Site map.
This site uses cookies to improve your experience. We use cookies and similar technologies to analyse traffic. We and our partners store information on your device. By continuing you agree to our use of cookies. You can change your choices at any time. Manage preferences. Cookie settings. Accept cookies. Reject all. Read our cookie policy for details. Your privacy matters to us. Usage data is shared with our partners. Only necessary cookies.
Table of contents. On this page. In this article. Related pages. Related content. See also. Recommended for you. Next page. Previous page. Attachments. Labels. Child pages. Recently viewed. Popular articles. Back to top.
¿Le ha resultado útil esta página? Valore esta página. Comparta este artículo. Imprima esta página. Copiar el enlace. Editado por última vez hace 12 días. Última modificación hace 12 días. A 12 personas les ha gustado. Aviso legal y privacidad. Condiciones del servicio. Política de privacidad. Portal de documentación de la empresa. Todos los derechos reservados. Este sitio utiliza cookies para mejorar su experiencia. Páginas relacionadas. Véase también.
War diese Seite hilfreich? Seite teilen. Seite drucken. Link kopieren. Zuletzt bearbeitet vor 12 Tagen. Zuletzt geändert am 12. Mai. 12 Personen gefällt das. Impressum. Datenschutz. Nutzungsbedingungen. Alle Rechte vorbehalten. Diese Seite verwendet Cookies. Verwandte Seiten. Siehe auch. Bereitgestellt vom Portal.
Esta página foi útil? Compartilhe esta página. Imprimir esta página. Copiar o link. Editado há 12 dias. Última atualização há 12 dias. 12 pessoas gostaram disto. Termos de uso. Política de privacidade. Aviso legal. Todos os direitos reservados. Este site usa cookies. Páginas relacionadas. Veja também.
"""


def latin(count: int = 400, seed: int = 11) -> list[str]:
    """Sentences of filler: words of the stock in any order, always the same ones."""
    words, draw = LATIN.split(), random.Random(seed)
    return [" ".join(draw.choice(words) for _ in range(draw.randint(6, 30))).capitalize() + "." for _ in range(count)]


ORDER, WINDOW, MARGIN, COVERAGE, SMOOTH, SLOTS, ROUNDS = 4, 18, 6.0, 0.5, 0.5, 1 << 16, 3
#: Characters of a body in windows of prose from which it is real, and what a window of prose must win by.
REAL_CHARS, REAL_MARGIN = 48, 3.0


def slots(text: str) -> np.ndarray:
    """A slot for the n-gram that ends at each character of a text; numbers are alike, and so are cases."""
    return slots_of_plain(plain(text))


def slots_of_plain(text: str) -> np.ndarray:
    points = np.frombuffer((" " * (ORDER - 1) + text).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    total = np.zeros(len(points) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        total = total * np.uint64(0x100000001B3) + points[i : len(points) - ORDER + 1 + i]
    return ((total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


#: Characters that are counted in one go.
AT_ONCE = 1 << 17


def tallied(texts: Iterable[str]) -> np.ndarray:
    """How often each slot comes in texts.  They are read as one, with blanks between them that stand for the start of each and aren't counted."""
    own, total = [plain(text) for text in texts], np.zeros(SLOTS, np.int64)
    for start, end in chunks_by_chars(own, AT_ONCE):
        every = slots_of_plain((" " * (ORDER - 1)).join(own[start:end]))
        counted = np.ones(len(every), bool)
        ends = np.cumsum([len(text) + ORDER - 1 for text in own[start:end]])[:-1]
        for i in range(1, ORDER):
            counted[ends - i] = False
        total += np.bincount(every[counted], minlength=SLOTS)
    return total


def fitted(counts: np.ndarray) -> np.ndarray:
    """Log probability of each slot."""
    return np.log((counts + SMOOTH) / (counts.sum() + SMOOTH * SLOTS)).astype(np.float32)


def phrases(source: str) -> list[str]:
    lines = [line for line in source.splitlines() if line.strip()]
    return lines + [s for line in lines for s in re.split(r"(?<=[.!?])\s+", line)]


#: What stands for prose where the corpus has none.
UNFITTED = "The service reads the key from the file and waits for the next request."


class Judge:
    """Coverage of texts by residue: windows that a model of residue explains better than those of prose and of page furniture.

    ``short`` are blocks of short bodies, unlabelled, that the models of residue learn from.
    """

    def __init__(self, prose: Iterable[str], furniture: Iterable[str] = (), short: list[str] = (), rounds: int = ROUNDS):
        self.learn(tallied(prose), tallied(furniture), (lambda: self.recognised(short)) if short else None, rounds)

    @classmethod
    def of_counts(cls, prose: np.ndarray, furniture: np.ndarray, recognised: Callable[[Judge], np.ndarray] | None, rounds: int = ROUNDS) -> Judge:
        """The same from counts of prose and furniture by slot; ``recognised`` counts by kind what a judge sees in the short blocks."""
        judge = cls.__new__(cls)
        judge.learn(prose, furniture, recognised and (lambda: recognised(judge)), rounds)
        return judge

    def learn(self, prose: np.ndarray, furniture: np.ndarray, recognised: Callable[[], np.ndarray] | None, rounds: int) -> None:
        cases = (*TEMPLATE_NAMES, *map(str.upper, TEMPLATE_NAMES))
        texts = [phrases(ERRORS), phrases(SCRIPTS), phrases(FILLER), latin(), [form % name for form in (*TEMPLATE_MARKS, *TEMPLATE_WORDS) for name in cases]]
        own = np.stack([*map(tallied, texts)])
        self.residues = len(texts)
        prose = prose if prose.any() else tallied([UNFITTED])
        furniture = 3 * tallied(phrases(FURNITURE)) + furniture
        self.fit(own, prose, furniture)
        for _ in range(rounds if recognised else 0):
            self.fit(own + recognised(), prose, furniture)

    def fit(self, residues: np.ndarray, prose: np.ndarray, furniture: np.ndarray) -> None:
        self.models = np.stack([*map(fitted, residues), fitted(prose), fitted(furniture)])

    def recognised(self, texts: Iterable[str]) -> np.ndarray:
        """Counts of slots, by kind, of the texts that are residue and nothing else."""
        found: list[list[str]] = [[] for _ in range(self.residues)]
        for text in texts:
            kind, covered, real = self.weighed(text)
            if covered >= COVERAGE and real < REAL_CHARS / 2:
                found[kind].append(text)
        return np.stack([*map(tallied, found)])

    def weighed(self, text: str) -> tuple[int, float, float]:
        """The kind of residue that explains a text best, the share of its characters in windows of residue, and the number of those in windows of prose."""
        own = slots(text)
        if not len(own):
            return 0, 0.0, 0.0
        sums = np.cumsum(np.concatenate([np.zeros((len(self.models), 1), np.float32), self.models[:, own]], 1), 1)
        width = min(WINDOW, len(own))
        windows = sums[:, width:] - sums[:, :-width]
        lead = windows[: self.residues].max(0)
        scale = width / WINDOW

        def inside(won: np.ndarray) -> int:
            marks = np.zeros(len(own) + 1, np.int64)
            won = won.astype(np.int64)
            marks[: len(won)] += won
            marks[width : width + len(won)] -= won
            return int(np.count_nonzero(np.cumsum(marks)[:-1]))

        covered = inside(lead - windows[self.residues :].max(0) >= MARGIN * scale)
        real = inside(windows[self.residues] - lead >= REAL_MARGIN * scale)
        return int(sums[: self.residues, -1].argmax()), covered / len(own), real * len(text) / len(own)

    def coverage(self, text: str) -> float:
        """Share of the characters that lie in windows of residue."""
        return self.weighed(text)[1]

    def is_residue(self, text: str) -> bool:
        return len(text) > 1 and self.coverage(text) >= COVERAGE

    def is_case(self, body: Iterable[str], rest: Iterable[str]) -> bool:
        """Whether the body's blocks hold nothing real, and these or the rest of the page's hold residue."""
        residue, total = False, 0.0
        for text in body:
            _, covered, real = self.weighed(text)
            residue |= covered >= COVERAGE and len(text) > 1
            if (total := total + real) >= REAL_CHARS:
                return False
        return residue or any(map(self.is_residue, rest))


def blocks(units: Iterable[Unit]) -> Iterator[str]:
    """Texts of the units' blocks but headings, and but units that are only links."""
    for unit in units:
        if unit.all_links():
            continue
        for block, own in groupby(unit.pieces, key=lambda p: p.element.block):
            if block.tag not in HEADINGS and (text := BLANK.sub(" ", "".join(p.text for p in own)).strip()):
                yield text


#: A recurring paragraph as short as this is furniture, not a leftover.
LEFTOVER = 12


def summed(texts: DataFrame, count: Callable[[list[str]], np.ndarray], rows: int) -> np.ndarray:
    """Sums by row and slot of what ``count`` makes of each batch of all texts, a matrix of ``rows`` by SLOTS: what is sent to the driver doesn't grow with the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, SLOTS), np.int64)
        for batch in batches:
            total += count(batch.column(0).to_pylist())
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(total.ravel()[places])], names=["place", "n"])

    found = texts.mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(rows * SLOTS, np.int64)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(rows, SLOTS)


def judge_of(surveyed: DataFrame) -> Judge:
    """Models fitted on every distinct block of long bodies, of short ones and of the rest of pages.

    Of the short ones, those that stand in long bodies too aren't learned from: they are furniture inside bodies, if far more long bodies have them, or leftovers.
    """
    noted = surveyed.where("kind = 3")
    prose, furniture = (summed(noted.where(f"page = {place}").select("text").distinct(), lambda texts: tallied(texts)[None], 1)[0] for place in (0, 2))
    met = surveyed.where("kind in (1, 4) and field = 'page_html'").select("key", "page", (F.col("wrapper") == "short").alias("short"))
    short = noted.where("page = 1").select("key", "text").distinct()
    met = met.join(short.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.countDistinct(F.when(~F.col("short"), F.col("page"))).alias("long"), F.countDistinct(F.when(F.col("short"), F.col("page"))).alias("short"))
    known = checkpointed(short.join(met, "key").groupBy("text").agg(F.sum("long").alias("long"), F.sum("short").alias("pages")))
    furniture = furniture + summed(known.where((F.col("long") >= FURNITURE_PAGES) & (F.col("long") >= FURNITURE_RATIO * F.col("pages"))).select("text"), lambda texts: tallied(texts)[None], 1)[0]
    learned = known.where("long = 0").select("text")
    if not prose.any():
        return Judge.of_counts(summed(learned, lambda texts: tallied(texts)[None], 1)[0], furniture, None)
    return Judge.of_counts(prose, furniture, lambda judge: summed(learned, judge.recognised, judge.residues))


def judged_pieces(fetches: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(fetch_id, residue, html_field, piece_no): the pieces of the main bodies, and a row with null pieces for each page that is residue."""
    path, surveyed = survey(fetches, fields)
    judge = judge_of(surveyed)
    kind = fetches.schema["fetch_id"].dataType.simpleString()

    def make(find):
        kept = lambda text: len(text) >= LEFTOVER and judge.is_residue(text)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, cases, names, numbers = [], [], [], []

            def emit(key, case, name, places):
                keys.extend([key] * len(places))
                cases.extend([case] * len(places))
                names.extend([name] * len(places))
                numbers.extend(places)

            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, _, page, export = row[:4]
                if page:
                    units = units_of(page)
                    wrapper, constants = find(row, FIELDS[0])
                    own = main_units(units, wrapper, constants, kept)
                    rest = (u for u in units if not any(k in constants.all for k in u.keys()))
                    if units and judge.is_case(blocks(own), blocks(rest)):
                        emit(key, True, None, [None])
                        continue
                    emit(key, False, FIELDS[0], [p.number for u in own for p in u.pieces])
                if export:
                    own = main_units(units_of(export), *find(row, FIELDS[1]), kept)
                    emit(key, False, FIELDS[1], [p.number for u in own for p in u.pieces])
            columns = [pa.array(keys, batch.schema.field(0).type), pa.array(cases, pa.bool_()), pa.array(names, pa.string()), pa.array(numbers, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["fetch_id", "residue", "html_field", "piece_no"])

        return step

    found = map_pages(fetches, wrappers(surveyed), make, f"fetch_id {kind}, residue boolean, html_field string, piece_no int", fields)
    dropped(fetches.sparkSession, path)  # wrappers and models are made, nothing reads it any more
    return found


def residue_fetches(fetches: DataFrame) -> DataFrame:
    """(fetch_id): the fetches whose page is residue."""
    return judged_pieces(fetches, FIELDS[:1]).where("residue").select("fetch_id").distinct()


def without_residue(fetches: DataFrame) -> DataFrame:
    """(fetch_id): the other fetches, once each."""
    return fetches.select("fetch_id").distinct().join(residue_fetches(fetches), "fetch_id", "left_anti")


def main_pieces(fetches: DataFrame) -> DataFrame:
    """(fetch_id, html_field, piece_no): the pieces of the main body of every fetch that isn't residue (problem 3)."""
    return judged_pieces(fetches).where("not residue").select("fetch_id", "html_field", "piece_no").distinct()
