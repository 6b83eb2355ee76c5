"""Rules the URL query applies (fixed values)."""

SITE_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]

# Words that mark a host: adverts and trackers, gambling, adult, medicine spam, link farms, warez.
BLOCKED_HOST_WORDS = (
    "ads adserver adservice adtech banner banners clicktrack tracker tracking track telemetry "
    "bet bets betting casino jackpot lottery poker roulette slots "
    "adult camgirls escort escorts porn sex xxx "
    "cialis pills viagra "
    "linkfarm spam spamfarm "
    "crack keygen torrents warez"
).split()

# Patterns over the whole URL.
BLOCKED_PATTERNS = ["/adserver/", "/adclick^", "^adframe.", "/popunder^", "/track/*.gif^"]
ALLOWED_PATTERNS = ["^anti-spam^", "^racetrack^track^", "^responsible-betting^"]
