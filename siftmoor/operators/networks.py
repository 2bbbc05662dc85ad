"""Addresses and hosts against tables: networks by longest prefix, safe domains by suffix.

Both tables may have any number of rows.  An address meets the networks through its
prefixes, a host the domains through its suffixes, so these are joins on equal keys;
each distinct address or host is looked up once, however often it occurs.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftmoor.fixed import detectors as fx
from siftmoor.operators.network import IPV4

_BITS = 32
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_ADDRESS = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_NETWORK = rf"^{_ADDRESS}(?:/(?:3[0-2]|[12]?[0-9]))?$"


def address_number(address: Column) -> Column:
    """The address as a number; null for texts that are no address (an octet over 255 or with a leading zero)."""
    parts = F.split(address, r"\.")
    number = sum((F.get(parts, i).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    return F.when(address.rlike(f"^{_ADDRESS}$"), number)


def default_networks(spark: SparkSession) -> DataFrame:
    """The networks that are not public, and the public ones inside them."""
    rows = [(cidr, "private") for cidr in fx.PRIVATE_RANGES] + [(cidr, "public") for cidr in fx.PRIVATE_HOLES]
    return spark.createDataFrame(rows, "cidr string, label string")


def parsed_networks(networks: DataFrame) -> DataFrame:
    """(bits, prefix, network, label), each network once, with the smallest of its labels.

    ``networks(cidr, label)``; an address without a length is a network of its own, bits beyond the length are cleared, and
    rows that are no network (null ones too) are left out.
    """
    parts = F.split("cidr", "/")
    bits = F.coalesce(F.get(parts, 1).cast("int"), F.lit(_BITS))
    known = networks.where(F.col("cidr").rlike(_NETWORK)).select(bits.alias("bits"), address_number(F.get(parts, 0)).alias("number"), "label")
    prefix = F.expr(f"shiftright(number, {_BITS} - bits)")
    low = F.expr(f"shiftleft(shiftright(number, {_BITS} - bits), {_BITS} - bits)")
    octets = [F.shiftright(low, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)]
    text = F.concat(F.concat_ws(".", *octets), F.lit("/"), F.col("bits").cast("string"))
    return known.select("bits", prefix.alias("prefix"), text.alias("network"), "label").groupBy("bits", "prefix", "network").agg(F.min("label").alias("label"))


def networks_of(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """All rows and columns of ``addresses(ip, ...)`` with ``network`` and ``label`` of the longest network that holds ``ip``.

    Both are null where none does and for texts that are no address.
    """
    table = parsed_networks(networks)
    lengths = sorted(r.bits for r in table.select("bits").distinct().collect())      # 33 at most
    once = addresses.select("ip").distinct().withColumn("number", address_number(F.col("ip"))).where("number IS NOT NULL")
    keys = F.array(*[F.struct(F.lit(n).alias("bits"), F.shiftright("number", _BITS - n).alias("prefix")) for n in lengths])
    if not lengths:
        keys = F.array().cast("array<struct<bits:int,prefix:bigint>>")
    found = once.select("ip", F.inline(keys)).join(table, ["bits", "prefix"]).groupBy("ip").agg(F.max_by(F.struct("network", "label"), "bits").alias("found"))
    return addresses.join(found, "ip", "left").select(*[addresses[c] for c in addresses.columns], "found.network", "found.label")


def is_address_text(host: Column) -> Column:
    return host.rlike("^" + IPV4)


def safe_hosts(hosts: DataFrame, domains: DataFrame, any_parent: bool = False) -> DataFrame:
    """The distinct ``host`` values that are in ``domains(domain)``, or whose last two labels are.

    With ``any_parent`` a domain covers all its subdomains at any depth and need not have two labels.
    """
    parts = F.split("host", r"\.", -1)
    depths = F.sequence(F.lit(1), F.size(parts)) if any_parent else F.array_distinct(F.array(F.size(parts), F.least(F.size(parts), F.lit(2))))
    keys = F.transform(depths, lambda n: F.array_join(F.slice(parts, -n, n), "."))
    once = hosts.select("host").where("host IS NOT NULL").distinct()
    return once.withColumn("domain", F.explode(keys)).join(domains.select("domain").distinct(), "domain", "left_semi").select("host").distinct()


def unsafe_hosts(hosts: DataFrame, domains: DataFrame, any_parent: bool = False) -> DataFrame:
    """The rows of ``hosts(host, ...)`` that no safe domain covers; hosts that are addresses or null are left out."""
    named = hosts.where(F.col("host").isNotNull() & ~is_address_text(F.col("host")))
    return named.join(safe_hosts(named, domains, any_parent), "host", "left_anti").select(*hosts.columns)
