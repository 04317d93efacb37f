"""Seed texts of the residue models: general wordings of filler and of notices, varied by rule.

They are written from common knowledge of templates and web servers, in the languages of the corpus, and none of them is
a sentence of a test document; ``tests/llm/test_residue.py`` holds wordings that are kept out of them.
"""

from __future__ import annotations

import random

# The standard dummy Latin, rows of a keyboard, words of no meaning, delimiters of template languages, HTTP reasons.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
KEY_ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
NONSENSE = "foo bar baz qux quux test testing blah xxx xxxx yyy zzz aaaa abc dummy".split()
DELIMITERS = ["{{ X }}", "{{X}}", "{{cookiecutter.X}}", "{{ page.X }}", "[[X]]", "[[ X ]]", "__X__", "@@X@@", "#{X}", "<<X>>", "<%= X %>", "<% X %>", "%X%", "%%X%%", "${X}", "${page.X}", "{% block X %}{% endblock %}", "{% X %}"]
ASKED = ["[insert X]", "[insert X here]", "[enter X]", "[your X]", "[your X here]", "[add X here]", "[TODO: X]", "[X here]", "<insert X>", "<enter X here>", "<enter your X>", "<enter the X>", "<your X>", "<your X here>", "<X goes here>", "(X to be added)", "(X to be filled in)", "(X to be determined)", "(add X later)", "(insert X)", "XXX X XXX", "TBD: X", "X goes here", "X to follow"]
SLOT_WORDS = "name address city country phone price product customer item category tag section chapter subject heading keyword department team role link image logo signature number amount user client site page field value text file report_name UserName company_address StartTime order_id".split()
REASONS = {
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable", 408: "Request Timeout", 409: "Conflict", 410: "Gone", 413: "Content Too Large", 414: "URI Too Long",
    415: "Unsupported Media Type", 418: "I'm a teapot", 422: "Unprocessable Content", 429: "Too Many Requests", 451: "Unavailable For Legal Reasons", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported",
}

FILLER_LINES = """Insert your text here. Enter some text here. Type your text here. Put content here. Write something here.
Description goes here. Your content goes here. The body goes here. A caption goes here.
This is dummy text. Some dummy text for now. Dummy content, please ignore.
This is only placeholder text. Placeholder paragraph. Placeholder for the introduction, will be replaced.
Sample paragraph. Example text that shows how the page will look. Replace it with your own content.
Please replace this sentence. To be replaced with the real text. Text to be replaced. Content coming soon.
Dies ist ein Typoblindtext. Blindtext. Ein Absatz Blindtext. Nur ein Platzhalter. Platzhalter für den Text.
Hier kommt Ihr Text hin. Fügen Sie hier Ihren Text ein. Bitte Text eingeben. Beispieltext. Mustertext.
텍스트를 여기에 입력해 주세요. 내용을 입력해 주세요. 이곳에 글을 작성하세요. 설명을 입력하세요.
예시 텍스트입니다. 샘플 문장입니다. 더미 텍스트. 임시 문구. 여기에 제목을 입력하세요.
Escriba su texto aquí. Introduzca el texto. Inserte aquí el contenido. Su texto aquí.
Esto es un texto de relleno. Texto de ejemplo. Texto provisional. Párrafo de muestra. Aquí va la descripción."""

NOTICE_LINES = """JavaScript must be enabled to use this website. JavaScript has been disabled. Your browser has JavaScript turned off.
This application needs JavaScript to work. We're sorry but this page doesn't work properly without JavaScript enabled.
Enable scripts in your browser settings and refresh the page. Turn JavaScript on, then try again. To view this content, allow scripts.
It looks like scripts are blocked by your browser. Scripts are turned off. This browser has no support for scripts. <noscript>JavaScript is required</noscript>
Loading, please wait. Please wait while we load the viewer. If nothing happens, enable JavaScript. Loading page...
Please enable cookies and reload. Cookies are disabled. One moment, the browser is being checked. Verify that you are human.
Die Seite benötigt JavaScript. JavaScript ist in Ihrem Browser deaktiviert. Bitte schalten Sie JavaScript ein, um den Inhalt anzuzeigen. JavaScript muss aktiviert sein.
자바스크립트를 사용할 수 없습니다. 브라우저에서 자바스크립트를 허용해 주세요. 자바스크립트를 켜야 이 내용을 볼 수 있습니다. 페이지를 새로 고치세요.
Necesita activar JavaScript para usar este sitio. JavaScript está desactivado. Active JavaScript en su navegador y vuelva a cargar la página para ver el contenido.
The page cannot be found. This page does not exist or has been moved. We could not find what you were looking for. It may have been removed or is no longer available.
The requested resource was not found on the server. The file could not be opened. No such page. Sorry, this document is not available anymore.
An unexpected error occurred. Something broke on our side. Oops, an error happened. A problem occurred while rendering the page. The preview could not be displayed. Failed to render. Cannot render the file. Unable to load the page. Reload the page.
The server encountered an error and could not complete your request. That's an error. That's all we know. The upstream server timed out. The connection timed out before an answer came. The gateway did not respond in time. The process was given up after 60 seconds.
You are not authorized to access this resource. Permission denied. You don't have access to this page. You need permission. Access to this resource is denied. Access forbidden. Please sign in to continue.
You have exceeded the rate limit. Rate limit exceeded for your IP address. Too many requests, please slow down and try again later. Please try again in a few minutes.
The file is not valid JSON. Error while parsing the notebook. Could not convert the file. Invalid notebook: unexpected end of input. Conversion failed.
Seite nicht verfügbar. Die gesuchte Seite existiert nicht mehr. Die Adresse wurde nicht gefunden. Zugriff nicht erlaubt. Fehler beim Laden. Ein Fehler ist aufgetreten (Fehler 503). Die Seite konnte nicht geladen werden.
페이지가 존재하지 않습니다. 찾으시는 페이지가 없습니다. 주소가 올바른지 확인해 주세요. 접근 권한이 없습니다. 오류가 발생했습니다 (503). 잠시 후 다시 시도해 주세요. 요청을 처리할 수 없습니다.
Página no encontrada. El recurso que busca no existe. La dirección no es válida. No tiene permiso para acceder. Se ha producido un error. Inténtelo de nuevo más tarde (error 503). No se pudo cargar la página solicitada.
Return to the home page | Contact | Help | Status page. Skip to main content. Log in. Request ID: 9f8e7d6c5b4a3210 Incident reference: #a1b2c3d4e5 server-17 edge-03
{"error": "resource missing", "code": 404, "path": "/files/index.html"} {"status": 500, "message": "unexpected failure"} {"detail": "rate limited"}"""


def mashed(rng: random.Random) -> str:
    """A run of keys: a piece of a row, one key again and again, or a word of no meaning."""
    row = rng.choice(KEY_ROWS)
    a = rng.randrange(len(row) - 3)
    return rng.choice([row[a : a + rng.randint(4, 6)], rng.choice(row) * rng.randint(3, 5), rng.choice(NONSENSE), rng.choice(NONSENSE)])


def seed_texts(rng_seed: int = 7) -> tuple[list[str], list[str]]:
    """(filler, notices): the seed texts, varied by rule."""
    rng = random.Random(rng_seed)
    filler = [" ".join(rng.choices(LATIN, k=20)).capitalize() + "." for _ in range(150)] + [" ".join(mashed(rng) for _ in range(12)) for _ in range(100)]
    filler += FILLER_LINES.split("\n") * 30
    for slot in DELIMITERS + ASKED:
        for word in SLOT_WORDS:
            forms = {word, word.upper(), word.capitalize()}
            filler += [slot.replace("XXX", "\0").replace("X", w).replace("\0", "XXX") for w in forms]
            if slot in ASKED:
                filler += [slot.upper().replace("XXX", "\0").replace("X", word.upper()).replace("\0", "XXX"), slot[0] + slot[1:].capitalize().replace("x", word, 1) if slot[1:].islower() else slot.replace("X", word, 1)]
    notices = NOTICE_LINES.split("\n") * 12
    for code, reason in REASONS.items():
        notices += [f"{code} {reason}", f"{code} : {reason}", f"HTTP {code} - {reason}", f"Error {code} ({reason})", f"Error code: {code}. {reason}.", f'{{"message": "{reason}", "status": {code}}}',
                    f"<html><head><title>{code} {reason}</title></head><body><center><h1>{reason}</h1></center><hr></body></html>"] * 4
    return filler, notices
