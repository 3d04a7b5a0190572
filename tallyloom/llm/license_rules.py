"""Signature rules for license notices.

Notices are matched in a text of lower-case words with one space between them,
so a version 2.0 reads ``2 0``. Each license gives up to four rules by kind, in
order of priority: an identifier line, an address, a grant and a bare name.
"""

from __future__ import annotations

from typing import NamedTuple

# Phrases and labels given with the task (fixed values).
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

KINDS = ("identifier", "address", "grant", "name")
CONFIDENCE = {"identifier": 1.0, "address": 0.95, "grant": 0.9, "name": 0.7}
BASE_CONFIDENCE = 0.6
LONGEST_MATCH = 24  # words; no rule matches more

_LICEN = "licen[sc]e"
_V = r"(?: version| v)? "


class License(NamedTuple):
    label: str
    keyword: str  # a part of each of its notices
    identifier: str  # words of its short identifier; empty: none
    address: str  # pattern of words of its address; empty: none
    name: str  # pattern of its name


def _creative_commons() -> list[License]:
    out = []
    parts = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
    for short, long in parts.items():
        words = short.replace("-", " ")
        for major, minor in (("1", "0"), ("2", "0"), ("2", "5"), ("3", "0"), ("4", "0")):
            out.append(License(f"cc-{short}-{major}.{minor}", f" {words} {major} {minor} ", f"cc {words} {major} {minor}", "", f"cc {words} {major} {minor}(?: international| unported)?"))
            out.append(License(f"cc-{short}-{major}.{minor}", f" {long} {major} {minor} ", "", f"creativecommons org licenses {words} {major} {minor}", f"creative commons {long} {major} {minor}(?: international| unported)?(?: public)?(?: {_LICEN})?"))
        out.append(License(f"cc-{short}", f"{words} ", "", f"creativecommons org licenses {words}", f"(?:cc {words}|creative commons {long})(?: {_LICEN})?"))
    return out


def _gnu() -> list[License]:
    out = []
    kinds = {"gpl": "general public", "lgpl": "(?:lesser|library) general public", "agpl": "affero general public"}
    for short, words in kinds.items():
        for version in {"gpl": ("1", "2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("1", "3")}[short]:
            dotted = version.replace(" ", ".") if " " in version else f"{version}.0"
            spelled = version if " " in version else f"{version}(?: 0)?"
            out.append(License(f"{short}-{dotted}", "general public", "", f"gnu org licenses {short} {spelled}", f"gnu {words} {_LICEN}{_V}{spelled}(?: or(?: at your option)? any later version| only)?"))
            out.append(License(f"{short}-{dotted}", f" {short}", f"{short} {dotted.replace('.', ' ')}(?: only| or later)?", f"opensource org licenses {short} {spelled}", f"(?:gnu )?{short}(?: version)? ?v?{spelled}(?: or later| only)?"))
        out.append(License(short, "general public", "", f"gnu org licenses {short}", f"gnu {words} {_LICEN}"))
    out.append(License("gfdl", "free documentation", "gfdl 1 [123](?: only| or later)?", "gnu org licenses fdl", f"gnu free documentation {_LICEN}(?:{_V}1 [123])?"))
    return out


def _versions(label: str, keyword: str, short: str, name: str, versions: tuple[str, ...]) -> list[License]:
    """A license with numbered versions and its name without one."""
    out = [License(f"{label}-{v}", keyword, f"{short} {v.replace('.', ' ')}", f"org licenses {short} {v.replace('.', ' ')}", f"{name}{_V}{v.replace('.', ' ')}") for v in versions]
    return [*out, License(label, keyword, "", "", name)]


LICENSES: list[License] = [
    *_creative_commons(),
    *_gnu(),
    *_versions("apache", "apache", "apache", f"apache(?: software)? {_LICEN}", ("1.0", "1.1", "2.0")),
    *_versions("mpl", "mozilla", "mpl", f"mozilla public {_LICEN}", ("1.0", "1.1", "2.0")),
    *_versions("epl", "eclipse", "epl", f"eclipse public {_LICEN}", ("1.0", "2.0")),
    *_versions("eupl", "european union", "eupl", f"european union public {_LICEN}", ("1.0", "1.1", "1.2")),
    *_versions("cddl", "common development", "cddl", f"common development and distribution {_LICEN}", ("1.0", "1.1")),
    *_versions("cpl", "common public", "cpl", f"common public {_LICEN}", ("1.0",)),
    *_versions("ipl", "ibm public", "ipl", f"ibm public {_LICEN}", ("1.0",)),
    *_versions("artistic", "artistic", "artistic", f"artistic {_LICEN}", ("1.0", "2.0")),
    *_versions("afl", "academic free", "afl", f"academic free {_LICEN}", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    *_versions("osl", "open software", "osl", f"open software {_LICEN}", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    *_versions("ofl", "font", "ofl", f"(?:sil )?open font {_LICEN}", ("1.0", "1.1")),
    *_versions("php", "php", "php", f"php {_LICEN}", ("3.0", "3.01")),
    *_versions("zpl", "zope", "zpl", f"zope public {_LICEN}", ("1.1", "2.0", "2.1")),
    *_versions("lppl", "latex", "lppl", f"latex project public {_LICEN}", ("1.0", "1.1", "1.2", "1.3a", "1.3c")),
    *_versions("apsl", "apple public", "apsl", f"apple public source {_LICEN}", ("1.0", "1.1", "1.2", "2.0")),
    *_versions("bsl", "boost", "bsl", f"boost software {_LICEN}", ("1.0",)),
    *_versions("upl", "universal permissive", "upl", f"universal permissive {_LICEN}", ("1.0",)),
    *_versions("ecl", "educational community", "ecl", f"educational community {_LICEN}", ("1.0", "2.0")),
    *_versions("efl", "eiffel", "efl", f"eiffel forum {_LICEN}", ("1.0", "2.0")),
    *_versions("rpl", "reciprocal public", "rpl", f"reciprocal public {_LICEN}", ("1.1", "1.5")),
    *_versions("qpl", "q public", "qpl", f"q public {_LICEN}", ("1.0",)),
    *_versions("odc-by", "open data commons", "odc by", f"open data commons attribution {_LICEN}", ("1.0",)),
    *_versions("odbl", "open database", "odbl", f"(?:open data commons )?open database {_LICEN}", ("1.0",)),
    *_versions("pddl", "public domain dedication", "pddl", f"(?:open data commons )?public domain dedication and {_LICEN}", ("1.0",)),
    *_versions("cc0", "cc0", "cc0", "cc0", ("1.0",)),
    License("mit", " mit ", "mit", "opensource org licenses mit", f"(?:the )?mit {_LICEN}"),
    License("mit-0", " mit ", "mit 0", "opensource org licenses mit 0", f"mit no attribution {_LICEN}"),
    License("x11", "x11", "x11", "", f"x11 {_LICEN}"),
    License("isc", " isc ", "isc", "opensource org licenses isc", f"isc {_LICEN}"),
    License("0bsd", "bsd", "0bsd", "opensource org licenses 0bsd", f"(?:bsd )?zero clause(?: bsd)? {_LICEN}"),
    License("bsd-2-clause", "bsd", "bsd 2 clause", "opensource org licenses bsd 2 clause", f"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: {_LICEN})?"),
    License("bsd-3-clause", "bsd", "bsd 3 clause", "opensource org licenses bsd 3 clause", f"(?:(?:new|modified|revised) bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: {_LICEN})?"),
    License("bsd-4-clause", "bsd", "bsd 4 clause", "", f"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: {_LICEN})?"),
    License("bsd", "bsd", "", "opensource org licenses bsd", f"bsd(?: style)? {_LICEN}"),
    License("zlib", "zlib", "zlib", "opensource org licenses zlib", f"zlib(?: libpng)? {_LICEN}"),
    License("libpng", "libpng", "libpng", "", f"(?:libpng|png reference library) {_LICEN}"),
    License("unlicense", "unlicense", "unlicense", "unlicense org", "the unlicense"),
    License("wtfpl", "wtfpl", "wtfpl", "wtfpl net", "wtfpl"),
    License("ncsa", "ncsa", "ncsa", "opensource org licenses ncsa", f"(?:university of illinois )?ncsa open source {_LICEN}"),
    License("python-2.0", "python", "python 2 0", "opensource org licenses python 2 0", f"python(?: software foundation)? {_LICEN}(?:{_V}2)?"),
    License("ruby", "ruby", "ruby", "", f"ruby {_LICEN}"),
    License("perl", "perl", "", "", "same terms as perl(?: itself)?"),
    License("postgresql", "postgresql", "postgresql", "opensource org licenses postgresql", f"postgresql {_LICEN}"),
    License("openssl", "openssl", "openssl", "openssl org source license", f"openssl {_LICEN}"),
    License("curl", "curl", "curl", "curl se docs copyright", f"curl {_LICEN}"),
    License("vim", " vim ", "vim", "", f"vim {_LICEN}"),
    License("ms-pl", "microsoft", "ms pl", "opensource org licenses ms pl", f"microsoft public {_LICEN}"),
    License("ms-rl", "microsoft", "ms rl", "opensource org licenses ms rl", f"microsoft reciprocal {_LICEN}"),
    License("sleepycat", "sleepycat", "sleepycat", "", f"sleepycat {_LICEN}"),
    License("w3c", "w3c", "w3c", "w3 org consortium legal", f"w3c software(?: notice and)? {_LICEN}"),
    License("unicode", "unicode", "unicode dfs 2016", "unicode org copyright", f"unicode {_LICEN}(?: agreement)?"),
    License("beerware", "beer", "beerware", "", f"beer ?ware {_LICEN}"),
    License("json", " json ", "json", "json org license", f"json {_LICEN}"),
    License("fair", " fair ", "fair", "", f"fair {_LICEN}"),
    License("elastic-2.0", "elastic", "elastic 2 0", "elastic co licensing elastic license", f"elastic {_LICEN}(?:{_V}2(?: 0)?)?"),
    License("sspl-1.0", "server side public", "sspl 1 0", "mongodb com licensing server side public license", f"server side public {_LICEN}(?:{_V}1(?: 0)?)?"),
    License("busl-1.1", "business source", "busl 1 1", "mariadb com bsl11", f"business source {_LICEN}(?:{_V}1 1)?"),
    License("openrail", "rail", "", "", f"(?:open ?rail(?: m)?|responsible ai) {_LICEN}"),
    License("public-domain", "public domain", "", "creativecommons org publicdomain", "(?:released|dedicated|placed|is) (?:in|in to|into|to) the public domain"),
    License("all-rights-reserved", "all rights reserved", "", "", "all rights reserved"),
]

# What a text must hold for any rule or phrase to match; tested before anything else.
# Between words of a part stand any characters that separate words.
GATE = ("licen", "spdx", "cc by", "creative", "cc0", "gpl", "gnu", "bsd", "public", "wtfpl", "mariadb", "curl", "unicode", "w3", "terms as perl", "reserved", "openssl")


class Rule(NamedTuple):
    label: str
    kind: str
    order: int  # priority: kinds first, then the order written
    keyword: str
    pattern: str


def rules() -> list[Rule]:
    """All rules in order of priority."""
    grant = f"(?:(?:dual )?licen[sc]ed|released|distributed|available|provided|published|redistributed|covered)(?: under| by)(?: the| a| an)?(?: terms of(?: the)?| conditions of(?: the)?)? "
    made: list[tuple[str, str, str, str]] = []
    for kind in KINDS:
        for lic in LICENSES:
            if kind == "identifier" and lic.identifier:
                made.append((lic.label, kind, "spdx", f"spdx licen[sc]e identifier {lic.identifier}"))
            elif kind == "address" and lic.address:
                made.append((lic.label, kind, lic.address.split(" (")[0].split("(")[0].split(" [")[0], lic.address))
            elif kind == "grant":
                made.append((lic.label, kind, lic.keyword, grant + lic.name))
            elif kind == "name":
                made.append((lic.label, kind, lic.keyword, lic.name))
    return [Rule(label, kind, order, keyword, f"(?<= )(?:{pattern})(?= )") for order, (label, kind, keyword, pattern) in enumerate(made)]
