"""URL rules for Python code on executors."""

import json
import re

_NEVER = re.compile(r"\s*(mailto|tel|javascript):", re.I)
_JSON = (re.compile(r'"href"\s*:\s*"([^"]+)"'), re.compile(r'"url"\s*:\s*"([^"]+)"'))


def followed(url: str) -> bool:
    """Whether a link leads to a page at all."""
    return not _NEVER.match(url)


def unescaped(text: str) -> str:
    """What a JSON string stands for; what is none stays as it is."""
    try:
        return json.loads(f'"{text}"')
    except ValueError:
        return text


def embedded(html: str) -> list[str]:
    """Links in JSON inside of a page: values of "href", then of "url", each once."""
    return list(dict.fromkeys(unescaped(x) for pattern in _JSON for x in pattern.findall(html)))
