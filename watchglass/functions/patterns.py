"""Patterns and word lists that decide what an indicator is.

Java's regular expressions; ``(?U)`` makes their classes Unicode's. No group is repeated without a bound or
possessively, as Java's matcher recurses for each repetition and a hostile text could exhaust the stack.
"""

# They must be these for right results.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
IPV6 = r"(?<![:\w])(?>(?:[0-9a-fA-F]{1,4}:|:){2,7})[0-9a-fA-F]{1,4}(?![:\w])"
URL = r"(?i)(?:https?|ftp)://[^\s\"'<>()\[\]{}|\\^`]+"
URL_TAIL = r"[.,;:!?)\]}\"']+$"
DOMAIN = r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.){1,126}[a-zA-Z]{2,}"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
FILE_SUFFIXES = (
    "exe dll sys ps1 bat cmd vbs js scr msi jar hta wsf lnk rb pl php py sh cpl inf reg psm1 psd1 chm jse wsh ocx drv "
    "docm xlsm pptm dotm xlam xlsb iso img vhd"
).split()
FILENAME = r"(?i)[A-Za-z0-9_][A-Za-z0-9_\-]{0,254}\.(?:" + "|".join(FILE_SUFFIXES) + ")"
SSDEEP = r"\d{1,8}:[A-Za-z0-9+/]{3,128}:[A-Za-z0-9+/]{3,128}"
TLSH = r"(?i)T?1?[A-F0-9]{70,72}"
HEX_LENGTHS = {"hash_sha512": 128, "hash_sha256": 64, "jarm": 62, "hash_sha1": 40, "hash_md5": 32}
KEYED_HASH = r"(?iU)\b(?:ja3s?|imphash)\s*[:=]\s*([0-9a-f]{32})\b"
CVE = r"(?i)CVE-\d{4}-\d{4,7}"
TECHNIQUE = r"T1\d{3}(?:\.\d{3})?"
ANY_TECHNIQUE = r"^T\d{4}(?:\.\d{3})?$"
HIVES = ("HKLM", "HKCU", "HKCR", "HKU", "HKCC", "HKEY_LOCAL_MACHINE", "HKEY_CURRENT_USER", "HKEY_CLASSES_ROOT", "HKEY_USERS", "HKEY_CURRENT_CONFIG")
REGISTRY = r"(?i)(?:" + "|".join(HIVES) + r")\\[^\s\"'<>|]+"
REGISTRY_TAIL = r"[.,;:)\"' ]+$"
ENCODED = r"(?iU)(?:(?:-|/)e(?:nc|ncoded(?:command)?)\s+|FromBase64String\s*\(\s*[\"'])([A-Za-z0-9+/=]{100,})"
ENCODED_PREFIX = "ps_encoded:"
EMPTY_HASHES = (
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)
INTERNAL_TLDS = "local internal corp test example invalid localhost lan home intranet localdomain domain arpa".split()
PRIVATE_NETS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10")
INVISIBLE = "​‌‍﻿⁠"
AT_AHEAD = r"(?=[A-Za-z0-9._\-]{1,60}(?:\[dot\]|\.))"
#: What undoes the masking of indicators, in this order.
REFANG = (
    (r"\[://\]", "://"),
    (r"(?iU)\bhxxp(s?)://", "http$1://"),
    (r"(?iU)\bhxtp(s?)://", "http$1://"),
    (r"(?iU)\bfxp://", "ftp://"),
    (r"\[\.\]", "."),
    (r"\(\.\)", "."),
    (r"\{\.\}", "."),
    (r"\[:\]", ":"),
    (r"\[/\]", "/"),
    (r"(?i)\[dot\]", "."),
    (r"(?i)\{dot\}", "."),
    (r"(?i)\(dot\)", "."),
    (r"(?i)\[at\]" + AT_AHEAD, "@"),
    (r"(?i)\(at\)" + AT_AHEAD, "@"),
    (r"(?i)\{at\}" + AT_AHEAD, "@"),
    ("．", "."),
    ("＠", "@"),
    ("：", ":"),
    ("／", "/"),
)
TUNNELS = (
    ".ngrok.io .ngrok.app .ngrok-free.app .serveo.net .trycloudflare.com .loca.lt .localtunnel.me .pagekite.me "
    ".tunnelmole.com .bore.pub"
).split()
PASTE_HOSTS = "pastebin.com paste.ee ghostbin.co hastebin.com rentry.co controlc.com dpaste.com".split()
CONTROL_HOSTS = "discord.com discordapp.com t.me api.telegram.org".split()
CONTROL_PATH = r"(?i)/(?:api/webhooks|bot[0-9]+:)"
PERSISTENCE = (
    r"\\Run",
    r"\\RunOnce",
    r"\\Image File Execution Options",
    r"\\Services\\",
    r"\\Winlogon\\",
    r"\\AppInit_DLLs",
    r"\\Active Setup",
    r"\\ShellServiceObjectDelayLoad",
)
SUSPICIOUS_TLDS = ".tk .ml .ga .cf .gq .pw .top .xyz .click .loan .work".split()
SUSPICIOUS_WORDS = "login secure update verify account signin banking password webscr".split()
HIGH_ENTROPY = 3.8
