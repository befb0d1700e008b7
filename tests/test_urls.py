from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from folioflow.functions.urls import NOT_ALLOWED, NOT_HTTPS, screen_url

ALLOWED = """
https://172.32.0.1/ https://8.8.8.8/ https://[2001:4860:4860::8888]/ https%3A%2F%2Fexample.com HTTPS://Example.com./
https://exa_mple.com/a https://a%2Bb.com/ https://localhost./ https://999.1.1.1/ https://08.8.8.8/ https://0x/ https://1.2.3.4.5/
https://4294967296/ https://256.1/ https://1.16777216/ https://1.2.65536/ https://127.0.0.1./ https://00000000000000010.1.1.1/
https://[::ffff:8.8.8.8]:443/ https://[::ffff:0808:0808]/ https://[2606:4700::1.2.3.4]/ https://[v1.abc]/ https://a:b:c/
https://a%zz.com/ https://a%.com https://a+b.com https://192.0.0.9/ https://[2001:1::1]/ https://[fec0::1]/
https://[3fff::1]/ https://example.com#https://10.0.0.1 https://example.com:x/ https://user@example.com
""".split()
NO_HTTPS = "http://example.com/ ftp://example.com //8.8.8.8/ https 8.8.8.8 httpsx://a.com/ mailto:a@b.c".split() + ["", " "]
REFUSED = """
https://LOCALHOST/ https://a.internal/ https://a.local:8443/x https://b.localhost?x https://localhost.localdomain https://10.0.0.1/
https://192.168.1.9/ https://172.31.0.1/ https://169.254.169.254/ https://127.1/ https://2130706433/ https://0x7f000001/ https://[::1]/
https://[::ffff:10.0.0.1]/ https://u:p@10.0.0.1/ https:///x https://100.100.100.200/ https://224.0.0.1/ https://0177.0.0.1/
https://0x00000000000007f.1/ https://[fe80::1%25eth0]/ https://[::8.8.8.8]/ https://[1:2:3:4:5:6:7::]/ https://[1:2:3:4:5:6:7:8:9]/
https://[1::2::3]/ https://[2606:4700::01.2.3.4]/ https://[12345::]/ https://[v1]/ https://[::1 https://x[::1]/ https://[::1]x/
https://a@b@[::1]/ https:8.8.8.8 https:/8.8.8.8 https: https://%31%30.0.0.1/ https://192.0.0.8/ https://192.0.0.170/ https://[2001:1::3]/
https://[2001:db8::1]/ https://[2002::1]/ https://[64:ff9b:1::1]/ https://[64:ff9b::1]/ https://[ff02::1]/ https://[100::1]/ https://[::]/ https://0/
https://10.0.0.1?x=@example.com https://10.0.0.1#@example.com https://example.com\\@10.0.0.1/ https://[fd00:ec2::254]/
""".split() + [" https://10.0.0.1/", "https:// 10.0.0.1 /", "https://10.0.0.1 x/", "ht\ntps://1\t0.0.0.1/", "https://10.0.0.1%20/"]


def spellings(n: int) -> dict[str, str | None]:
    """Random addresses in all spellings, judged by what the standard library knows of the address."""
    rng = random.Random(3)
    out: dict[str, str | None] = {}
    for _ in range(n):
        v = rng.choice([rng.getrandbits(32), rng.getrandbits(24), (10 << 24) + rng.getrandbits(8), (100 << 24) + rng.getrandbits(24)])
        four = ipaddress.IPv4Address(v)
        six = ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), 1 << 125 | rng.getrandbits(125), (0x2001 << 112) + rng.getrandbits(112)]))
        a, b, c, d = four.packed
        address, host = rng.choice([
            (four, str(four)), (four, str(v)), (four, hex(v)), (four, f"0{v:o}"), (four, f"{a}.{v & 0xffffff}"),
            (four, f"{a:#X}.0{b:o}.{v & 0xffff}"), (four, f"[::ffff:{four}]"), (four, f"[::FFFF:{v >> 16:x}:{v & 0xffff:x}]"),
            (six, f"[{six}]"), (six, f"[{six.exploded}]"), (None, f"{four}.com"), (None, f"h{v}.example.com"),
        ])
        fine = address is None or (address.is_global and not address.is_multicast and not address.is_reserved)
        out[f"https://{host}{rng.choice(['', '/', ':8443', '/v1?x=1'])}"] = None if fine else NOT_ALLOWED
    return out


def test_screen(spark):
    want = {**dict.fromkeys(ALLOWED), **dict.fromkeys(NO_HTTPS, NOT_HTTPS), **dict.fromkeys(REFUSED, NOT_ALLOWED), **spellings(2000)}
    df = spark.createDataFrame(list(enumerate(want)), "i INT, url STRING")
    got = {r.url: r.reason for r in df.select("url", screen_url(F.col("url")).alias("reason")).collect()}
    assert {u: (got[u], want[u]) for u in want if got[u] != want[u]} == {}


def test_missing_url_is_refused(spark):
    assert spark.range(1).select(screen_url(F.lit(None).cast("string"))).first()[0] == NOT_HTTPS


def test_hosts_that_normalise_to_delimiters_are_refused(spark):
    urls = ["https://a\u2100.example.com/", "https://a\uff03b.example.com", "https://a\u00e9.example.com/"]
    df = spark.createDataFrame([(u,) for u in urls], "u STRING")
    got = [r[0] for r in df.select(screen_url(F.col("u"))).collect()]
    assert got == ["not_allowed", "not_allowed", None]
