"""Network indicators: IPv4 addresses, suspicious ports, domains of URLs."""

import ipaddress

from pyspark.sql import Column, functions as F

from siftmoor.fixed import detectors as fx
from siftmoor.functions.regex import to_java
from siftmoor.functions.text import let, sql_array, sql_text
from siftmoor.operators.anchors import HTTP, SCHEME, Anchors
from siftmoor.operators.hits import NETWORK, hit, no_hits
from siftmoor.operators.rulebook import DOMAIN_ID, PORT_BASE, PUBLIC_IP_ID

IPV4 = to_java(fx.IPV4, "")
URL = to_java(fx.URL)
_DOTTED = r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"


def addresses(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(IPV4), F.lit(0))


def urls(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(URL), F.lit(0))


def domain(url: Column) -> Column:
    host = F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return F.lower(F.split_part(host, F.lit(":"), F.lit(1)))


def ports_of(line: Column) -> Column:
    """Places in the port list of the ports named in a stripped line."""
    table = ", ".join(
        f"named_struct('i', {i}, 'text', '{port}', 'word', {sql_text(to_java(rf'\b{port}\b', ''))})"
        for i, (port, _) in enumerate(fx.PORTS))
    named = F.filter(F.expr(f"array({table})"), lambda p: line.contains(p["text"]) & F.regexp_like(line, p["word"]))
    in_context = F.lower(line).rlike("|".join(fx.PORT_CONTEXT))
    return F.when(in_context, F.transform(named, lambda p: p["i"])).otherwise(F.array().cast("array<int>"))


def _number(address: Column) -> Column:
    parts = F.split(address, r"\.")
    return sum((F.get(parts, i).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0))


def _in_ranges(number: Column, ranges: list[str]) -> Column:
    nets = [ipaddress.ip_network(text) for text in ranges]
    table = ", ".join(f"named_struct('lo', {int(net[0])}L, 'hi', {int(net[-1])}L)" for net in nets)
    return F.exists(F.expr(f"array({table})"), lambda r: number.between(r["lo"], r["hi"]))


def is_private(address: Column) -> Column:
    """Not a public address; octets with a leading zero are no valid address and count as public."""
    valid = ~address.rlike(r"(^|\.)0[0-9]")
    return valid & let(_number(address), lambda n: _in_ranges(n, fx.PRIVATE_RANGES) & ~_in_ranges(n, fx.PRIVATE_HOLES))


def is_suspicious(host: Column) -> Column:
    parts = F.split(host, r"\.", -1)
    base = F.concat_ws(".", F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1))
    known = F.expr(sql_array(fx.SAFE_DOMAINS))
    safe = F.array_contains(known, host) | ((F.size(parts) >= 2) & F.array_contains(known, base))
    return ~host.rlike("^" + IPV4) & ~safe


def suspicion(host: Column) -> Column:
    """Why a suspicious domain is one: its top-level domain, dynamic DNS, or just unknown."""
    def ends(options):
        return F.exists(F.expr(sql_array(options)), lambda text: host.endswith(text))

    return F.when(ends(fx.RISKY_TLDS), "tld").when(ends(fx.DYNAMIC_DNS), "dynamic dns").otherwise("unknown")


def network_items(anchors: Anchors) -> Column:
    """``array<struct<n, kind, i, value, line, bad>>``: every indicator of a file, in detector order.

    kind 0 = address, 1 = port (value is the place in the port list), 2 = domain;
    ``bad`` says whether the indicator is also a finding.  Needs ``with_lines``.
    """
    def item(n, kind, i, value, line, bad):
        return F.struct(n.alias("n"), F.lit(kind).alias("kind"), i.alias("i"), value.alias("value"),
                        F.substring(line, 1, fx.NETWORK_LINE_CHARS).alias("line"), bad.alias("bad"))

    port_texts = F.expr(sql_array([str(port) for port, _ in fx.PORTS]))

    def of_line(x):
        n, line = x["n"], x["s"]
        ips = F.transform(addresses(line), lambda a, i: item(n, 0, i, a, line, ~is_private(a)))
        ports = F.transform(ports_of(line), lambda i: item(n, 1, i, F.get(port_texts, i), line, F.lit(True)))
        hosts = F.transform(urls(line), lambda u, i: let(
            domain(u), lambda d: item(n, 2, i, d, line, is_suspicious(d))))
        return F.concat(ips, ports, hosts)

    text = F.col("text")
    port_texts_any = "|".join(str(port) for port, _ in fx.PORTS)
    hints = F.struct(
        text.rlike(_DOTTED).alias("dots"),
        F.expr(anchors.any_of([str(port) for port, _ in fx.PORTS])).alias("port"),
        F.expr(f"{anchors.any_of([HTTP])} AND {anchors.any_of([SCHEME])}").alias("url"))

    def of_file(hint):
        lines = F.filter("code", lambda x: (
            (hint["dots"] & x["s"].rlike(_DOTTED)) | (hint["port"] & x["s"].rlike(port_texts_any))
            | (hint["url"] & x["s"].contains("://"))))
        return F.when(hint["dots"] | hint["port"] | hint["url"], F.flatten(F.transform(lines, of_line))).otherwise(none)

    none = F.array().cast("array<struct<n:int,kind:int,i:int,value:string,line:string,bad:boolean>>")
    return F.coalesce(let(hints, of_file), none)


def network_hits(items: Column) -> Column:
    def as_hit(x):
        kind = x["kind"]
        return hit(
            NETWORK, x["n"], kind, x["i"],
            F.when(kind == 0, F.lit(PUBLIC_IP_ID)).when(kind == 1, F.lit(PORT_BASE) - x["i"]).otherwise(DOMAIN_ID),
            x["n"], x["line"], x["value"], x["value"])

    return F.coalesce(F.transform(F.filter(items, lambda x: x["bad"]), as_hit), no_hits())


def network_indicators(items: Column) -> Column:
    """Sorted distinct ``IP: ``, ``Port: `` and ``Domain: `` texts of a file."""
    prefixes = F.array(F.lit("IP: "), F.lit("Port: "), F.lit("Domain: "))
    return F.array_sort(F.array_distinct(
        F.transform(items, lambda x: F.concat(F.get(prefixes, x["kind"]), x["value"]))))
