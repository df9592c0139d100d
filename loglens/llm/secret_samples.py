"""Labelled strings for the models of ``secrets``: ordinary identifiers and random strings.

The labels hold by construction.  Ordinary strings are words joined in the
usual ways, with and without numbers, paths, stamps, numeric ids and rule
lines; random ones are drawn letter by letter from the usual alphabets.  All
come from fixed seeds, so every run trains on the same ones.
"""

from __future__ import annotations

import random
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

# Words, names and alphabets.
WORDS = (
    "access account action active address admin agent alert alpha amount answer archive array article asset author backup balance batch binary block "
    "board body bridge browser buffer build bundle button cache call campaign cancel canvas card cart catalog category center channel chapter check "
    "child class clean client clock close cloud cluster code column command comment commit common company compile config connect console contact "
    "content context control cookie copy core count country create credit current custom customer cycle data database date debug default delete deploy "
    "design desktop detail device dialog direct display document domain download draft driver edit editor element email empty enable engine entity "
    "entry error event example exception execute export express external factory feature fetch field file filter final find folder footer form format "
    "forum frame function gallery game gateway general generate global graph group guide handler hash header health height hidden history home host "
    "http https icon image import index info initial inner input insert install instance integer interface internal invoice item java javascript job "
    "journal key label language layer layout length level library license limit line link linux list local location lock log login long lower main "
    "manager map market master max media member memory menu merge message method min mobile mode model module monitor month move name network new news "
    "next node note notify number object offset old online open option order org output owner package page panel parent parse partner path pattern "
    "payment people phone photo pixel platform player plugin point policy pool popular port portal position post power preview price primary print "
    "private process product profile program project property protocol provider proxy public python query queue quick random range rate read ready "
    "record redirect region register release remote remove render replace report request reset resource response rest result return review role root "
    "route row rule sample save scale schedule schema scope screen script search season secondary section secure select sender server service session "
    "set setting share shop short side signal simple single site size small social socket sort source space spark spec split sport stage standard "
    "start state static status step stop storage store story stream string style submit success summary supply support switch symbol sync system table "
    "target task team template test text theme thread time title toggle token tool topic total track travel tree trigger type unit update upload url "
    "user util valid value vendor version video view visit volume wait watch web week weight widget width window word work world wrapper write year zone"
).split()
NAMES = (
    "x86_64-linux-gnu utf8mb4_unicode_ci us-east-1 eu-central-1 ISO-8859-15 EC2InstanceProfile python3-setuptools base64 sha256sum md5sum ipv6 oauth2 "
    "amd64 i386 win32 aarch64-apple-darwin ubuntu-22 log4j2 k8s-node-01 covid-19 mp3 h264 1080p en_US de_DE fr-FR wp-content/uploads/2019/04 "
    "node_modules/react-dom/index cgi-bin/default ABC-12345-XY ISBN-978-3-16-148410-0 2nd-generation 3rd-party 24-hour-service 100-percent"
).split()
ALPHABETS = (
    digits + "abcdef",
    digits + "ABCDEF",
    ascii_uppercase + "234567",
    ascii_uppercase + digits,
    ascii_lowercase + digits,
    ascii_letters + digits,
    ascii_letters + digits + "+/",
    ascii_letters + digits + "-_",
)
# End of the fixed values.


def _number(rng: random.Random) -> str:
    return str(rng.randrange(10 ** rng.randint(1, 6)))


def _stamp(rng: random.Random, sign: str) -> str:
    date = sign.join((f"{rng.randint(1970, 2039)}", f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}"))
    time = sign.join(f"{rng.randrange(n):02}" for n in (24, 60, 60))
    return rng.choice((f"{date}T{time}Z", f"{date}_{time}", f"{date}-{time}", f"{date}T{time}+0{rng.randint(0, 9)}00", date + time))


def ordinary(seed: int, words: list[str] = WORDS, each: int = 250) -> dict[str, list[str]]:
    """Ordinary strings by their shape."""
    rng = random.Random(seed)

    def some(least: int = 2, most: int = 5) -> list[str]:
        parts = [rng.choice(words) for _ in range(rng.randint(least, most))]
        if rng.random() < 0.3:
            parts[rng.randrange(len(parts))] += _number(rng)[:4]
        if rng.random() < 0.3:
            parts.append(_number(rng))
        return parts

    def path() -> str:
        parts = ["-".join(some(2, 4)) if rng.random() < 0.3 else "_".join(some(2, 3)) if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(2, 5))]
        if rng.random() < 0.5:
            at = rng.randrange(len(parts))
            parts[at:at] = [f"{rng.randint(1990, 2029)}", f"{rng.randint(1, 12):02}", f"{rng.randint(1, 31):02}"][: rng.randint(1, 3)]
        if rng.random() < 0.3:
            parts.append(_number(rng))
        return rng.choice(("", "/", "//")) + "/".join(parts) + rng.choice(("", "/"))

    def capital(x: str) -> str:
        return x[0].upper() + x[1:]

    def camel() -> str:
        first, *rest = some()
        return first + "".join(map(capital, rest))

    def padded() -> str:
        sign = rng.choice("-=_+/")
        return sign * rng.randint(1, 20) + rng.choice(("-", "_")).join(some(1, 3) if rng.random() < 0.5 else [rng.choice(words)]) + sign * rng.randint(1, 20)

    shapes = {
        "snake": lambda: "_".join(some()),
        "kebab": lambda: "-".join(some()),
        "constant": lambda: "_".join(some()).upper(),
        "camel": camel,
        "pascal": lambda: capital(camel()),
        "path": path,
        "query": lambda: "=".join(some(2, 2)) + rng.choice(("", "/" + rng.choice(words))),
        "stamp": lambda: _stamp(rng, rng.choice(("-", "", "/", "_"))),
        "numeric": lambda: "".join(rng.choice(digits) for _ in range(rng.randint(12, 30))),
        "groups": lambda: rng.choice("-/_").join("".join(rng.choice(digits) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 6))),
        "code": lambda: "".join(rng.choice(ascii_uppercase) for _ in range(rng.randint(2, 3))) + "-" + "-".join(f"{rng.randrange(10**6):0{rng.randint(4, 6)}}" for _ in range(rng.randint(2, 3))),
        "padded": padded,
        "rule": lambda: (rng.choice(("-", "=", "_", "/", "+", "-=", "=-", "+-", "-+", "_-", "/-")) * 40)[: rng.randint(16, 80)],
    }
    return {shape: [make() for _ in range(each)] for shape, make in shapes.items()}


def drawn(seed: int, each: int = 250) -> dict[str, list[str]]:
    """Random strings by their alphabet."""
    rng = random.Random(seed)
    return {a: ["".join(rng.choice(a) for _ in range(rng.randint(20, 44))) + ("=" * rng.randrange(3) if "+" in a else "") for _ in range(each)] for a in ALPHABETS}


def training() -> dict[bool, list[str]]:
    """Distinct labelled strings: True are random (without padding, which is not drawn), False ordinary."""
    ours = [*WORDS, *NAMES, *(x for xs in ordinary(1).values() for x in xs)]
    return {True: sorted({x.rstrip("=") for xs in drawn(2).values() for x in xs}), False: sorted(set(ours))}
