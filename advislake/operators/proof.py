"""Whether a finding is the public syntax of the source value that holds it.

A detector reports shapes; a version in a version field or a host in a published reference has such a
shape without telling anything private. Every category has its own rule over the whole value, the place of
the span in it and the pointer of the source; a category without a rule is never proved.
"""
from pyspark.sql import Column, functions as F

from advislake.functions.exprs import let, truthy, within
from advislake.operators.privacy import ipv4_number

# fixed values: fields of a source that hold versions, the words before a tested address, and the archive
# whose message links carry addresses
VERSION_FIELDS = ["version", "lessThan", "lessThanOrEqual", "versionStartIncluding", "versionStartExcluding",
                  "versionEndIncluding", "versionEndExcluding"]
FIXED_BUILD = "^/Vulnerability/[0-9]+/Remediations/[0-9]+/FixedBuild$"
TESTED_ADDRESS = r"(?i)\b(?:versions?\s+(?:from|before|through)|reproduced\s+on)\s+$"
TESTED_WINDOW = 60
MAIL_ARCHIVE = "https://lore.kernel.org/"
# fixed values: special-purpose IPv4 blocks that are not globally reachable
LOCAL_BLOCKS = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255")]


def _quad(text: str) -> int:
    number = 0
    for part in text.split("."):
        number = number * 256 + int(part)
    return number


def globally_reachable(address: Column) -> Column:
    """Of a 32-bit address: outside every block kept for local or special use."""
    local = F.lit(False)
    for low, high in LOCAL_BLOCKS:
        local = local | address.between(_quad(low), _quad(high))
    return truthy(~local)


def link_around(value: Column, span: Column, start: Column) -> Column:
    """The http(s) or tps link that covers ``span`` at ``start`` of ``value``; null when none does.

    Links end at white space, quotes and angle brackets, so the run of other characters around the span
    holds at most one: from the run's first scheme to its end. No other part of a long value is searched.
    """
    before = F.regexp_extract(F.substr(value, F.lit(1), start), r"(?U)[^\s<>\"']*$", 0)
    after = F.regexp_extract(F.substr(value, start + 1), r"(?U)^[^\s<>\"']*", 0)
    run = F.concat(before, after)
    link = F.regexp_extract(run, r"(?s)(?:https?|tps)://.+", 0)
    lead = F.length(run) - F.length(link)
    return F.when((link != "") & (lead <= F.length(before)) & (F.length(span) <= F.length(after)), link)


def _bare(host: Column) -> Column:
    return F.rtrim(F.lower(host), F.lit("."))


def public_syntax(value: Column, span: Column, start: Column, category: Column, pointer: Column) -> Column:
    """Whether the span at ``start`` of the source value is public there; false where no rule says so."""
    name = F.substring_index(pointer, "/", -1)
    lead_in = F.substr(value, F.greatest(start - TESTED_WINDOW, F.lit(0)) + 1, F.least(start, F.lit(TESTED_WINDOW)))
    address = (within(name, VERSION_FIELDS) & F.contains(pointer, F.lit("/"))) | F.rlike(pointer, F.lit(FIXED_BUILD)) | (
        F.rlike(lead_in, F.lit(TESTED_ADDRESS)) & let(ipv4_number(span), globally_reachable))
    link = link_around(value, span, start)
    authority = F.regexp_extract(link, r"(?s)^[a-z]+://([^/]*)", 1)
    host = (_bare(span) == _bare(authority)) | (_bare(span) == _bare(F.substring_index(authority, ":", 1)))
    mail = F.startswith(link, F.lit(MAIL_ARCHIVE)) & F.contains(F.substr(link, F.lit(len(MAIL_ARCHIVE) + 1)), span)
    return truthy(F.when(category == "ipv4_address", address).when(category == "hostname", host)
                  .when(category == "guid", link.isNotNull() & F.endswith(pointer, F.lit("/URL")))
                  .when(category == "email_address", mail))
