"""Extension points: named callables of several kinds, most of them from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("connector", "mapper", "resolver", "enricher", "rule", "scorer", "notifier", "tool")
_HELD: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Decorator that files a callable under a kind and a name; a name is given once."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")

    def file(f: Callable) -> Callable:
        if _HELD.setdefault((kind, name), f) is not f:
            raise ValueError(f"{kind} {name} is there already")
        return f

    return file


def get(kind: str, name: str) -> Callable:
    return _HELD[kind, name]


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _HELD if k == kind)


def _built_in() -> None:
    from quillon.operators import mapping as M
    from quillon.sources import files as S

    scans = {
        "opensanctions": (S.entity_lines, M.bulk), "geonames": (S.places, M.places), "feeds": (S.feed_entries, M.feed), "opencorporates": (S.company_pages, M.companies),
        "mitre_attack": (S.intrusion_sets, M.intrusion_sets), "feodo": (S.blocklist, M.blocklist), "threatfox": (S.ioc_records, M.indicators), "urlhaus": (S.url_records, M.urls),
        "sslbl": (S.certificate_lines, M.certificates), "ransomware_victims": (S.victims, M.ransomware), "ransomware_groups": (S.groups, M.ransomware),
        "dig": (S.tool_output, M.dig), "nmap": (S.tool_output, M.nmap), "whois": (S.tool_output, M.whois),
    }
    for name, (scan, mapping) in scans.items():
        _HELD.setdefault(("connector", name), scan)
        _HELD.setdefault(("mapper", name), mapping)
    _HELD.setdefault(("enricher", "wikidata"), M.enrich_wikidata)


_built_in()
