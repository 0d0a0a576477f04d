import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import endings, numbers, text, times, units


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_numbers(spark):
    lit = F.lit
    r = one(spark, up=numbers.rate(lit(30), lit(10), lit(10)), back=numbers.rate(lit(10), lit(30), lit(10)), still=numbers.rate(lit(10), lit(10), lit(0)), pct=numbers.percent(lit(1), lit(4)), none=numbers.percent(lit(1), lit(0)), wait=numbers.await_ms(lit(5), lit(5), lit(9), lit(1)))
    assert (r.up, r.back, r.still, r.pct, r.none, r.wait) == (2.0, None, None, 25.0, None, 0.0)
    r = one(spark, reset=numbers.pressure_pct(lit(1), lit(9_000_000), lit(1), 100.0), most=numbers.pressure_pct(lit(9_000_000), lit(1), lit(1), 100.0), still=numbers.pressure_pct(lit(2), lit(1), lit(0), 100.0), open=numbers.pressure_pct(lit(1), lit(2), lit(1)))
    assert (r.reset, r.most, r.still, r.open) == (0.0, 100.0, None, None)
    for value, want in ((13.99709, 13.997), (0.0004, 0.0), (0.0167, 0.017), (-2.3456, -2.346), (999.9999, 1000.0), (7180264.329, 7180264.0), (0.5005, 0.5), (float("nan"), None), (float("inf"), None)):
        assert one(spark, v=numbers.measured(lit(value))).v == want
    r = one(spark, both=numbers.add(lit(None).cast("int"), lit(None).cast("int")), left=numbers.add(lit(3), lit(None).cast("int")), tick=numbers.next_tick(lit(60), 30), b=numbers.bucket(lit(-1), 300))
    assert (r.both, r.left, r.tick, r.b) == (None, 3, 90, -300)


def test_endings(spark):
    rows = [(0, "0", 0, None, "info", "exited 0"), (0x0100, "1", 1, None, "notice", "exited 1"), (0xFF00, "255", 255, None, "notice", "exited 255"), (9, "SIGKILL", None, False, "warning", "killed by SIGKILL"), (0x8B, "SIGSEGV", None, True, "error", "killed by SIGSEGV (core dumped)"), (40, "SIG40", None, False, "notice", "killed by SIG40")]
    df = spark.createDataFrame([(r[0],) for r in rows], "wait int")
    got = df.select("wait", endings.status_text("wait"), endings.exit_code("wait"), endings.core_dumped("wait"), endings.level(endings.status_text("wait")), endings.describe("wait")).collect()
    assert [tuple(r) for r in got] == rows
    assert one(spark, s=endings.span_status(F.lit("unknown"))).s == "unset"


def test_words_for_times_and_sizes():
    assert [text.duration_text(s) for s in (0.34, 12.54, 247, 7380, 90_000, 1.25, -1)] == ["340ms", "12.5s", "4m07s", "2h03m", "1d01h", "1.2s", "0ms"]
    assert [text.bytes_text(n) for n in (512, 12_288, 340 << 20, 3 << 29)] == ["512 B", "12.0 KiB", "340 MiB", "1.5 GiB"]
    assert text.fold("one two three", 7) == ["one two", "three"] and text.fold("abcdefghij", 4) == ["abcd", "efgh", "ij"]


@pytest.mark.parametrize(
    "line, kept",
    [
        ("loader --db-password=rosebud --jobs=4", "loader --db-password=*** --jobs=4"),
        ("render -authtoken 88a1 scene.blend", "render -authtoken *** scene.blend"),
        ("MAIL_PASSPHRASE=moon STAGE=prod send", "MAIL_PASSPHRASE=*** STAGE=prod send"),
        ("pull ftp://robot:xyzzy@files.test:21/in?all=1", "pull ftp://robot:***@files.test:21/in?all=1"),
        ("job --store=redis://me:pw@127.0.0.1/3", "job --store=redis://me:***@127.0.0.1/3"),
        ("sign --cookie", "sign --cookie"),
        ("scp ann@backup:", "scp ann@backup:"),
        ("tool --secret=", "tool --secret="),
        ("less secret.txt notes", "less secret.txt notes"),
        ("get http://site/q?at=9@8:7", "get http://site/q?at=9@8:7"),
    ],
)
def test_secrets_withheld(line, kept):
    assert text.command_line(line.replace(" ", "\0"), 400) == kept


def test_command_lines_are_cut_between_characters():
    assert text.command_line("é" * 10, 5) == "éé…"


UNIT_NAMES = {
    "app-niri-gimp-77ab90c1.scope": "app-niri-gimp.scope", "app-io.site.Editor-30211.scope": "app-io.site.Editor.scope", "session-c17.scope": "session-c17.scope", "session-44.scope": "session.scope", "run-u88.service": "run.service", "pane-1f2e3d4c-5b6a-7988-a7b6.scope": "pane.scope",
    "app-dead-beef.scope": "app-dead-beef.scope", "9f8e7d6c5b4a.scope": "transient.scope", "123456789.service": "transient.service", "boot.scope": "boot.scope", "redis-7.service": "redis-7.service", "web-20260101.service": "web.service", "web-ab12cd34.service": "web.service", "web-abcdefab.service": "web-abcdefab.service",
    "tty@tty9.service": "tty@tty9.service", "user@502.service": "user@502.service", "console@3:4.service": "console@3:4.service", "dump@7-881-2.service": "dump@.service", "dump@1-2-3_4-5.service": "dump@.service", "job@ab12cd.service": "job@.service", "job@abcdef.service": "job@abcdef.service",
    "check@99-10.9.8.7:80-10.9.8.6:55001.service": "check@.service", "login@8-[fe80::1]:22-[fe80::2]:50505.service": "login@.service", "user-502.slice": "user-502.slice", "bare": "bare", "odd.mount": "odd.mount", "run-a@1.scope": "run-a@.scope",
}


def test_unit_names(spark):
    rows = spark.createDataFrame(list(UNIT_NAMES.items()), "name string, want string")
    assert {r.name: r.got for r in rows.select("name", units.stable_name("name").alias("got")).collect()} == UNIT_NAMES


def test_escapes(spark):
    names = {"a\\x2db\\x2Dc": "a-b-c", "\\xc3\\xa9t\\xc3\\xa9": "été", "\\x2": "\\x2", "\\xzz1": "\\xzz1", "plain": "plain", "": "", "\\xff!": "\ufffd!", "é\\x40": "é@"}
    paths = {"/with\\040space": "/with space", "/t\\011ab\\134": "/t\tab\\", "/\\303\\251": "/é", "/\\9": "/\\9"}
    for of, cases in ((text.unescaped, names), (text.octal_unescaped, paths)):
        rows = spark.createDataFrame([(k,) for k in cases], "t string")
        assert {r.t: r.got for r in rows.select("t", of("t").alias("got")).collect()} == cases


def test_units_of_control_groups(spark):
    container = "a" * 63 + "1"
    paths = [("/system.slice/sshd.service",), ("/user.slice/user-1000.slice/user@1000.service/app.slice/app-x-12345.scope",), ("/user.slice",), ("/system.slice/db.service/inner/deep",), (f"/system.slice/docker-{container}.scope",), (f"/system.slice/caddy.service/libpod-payload-{container}",), ("/user.slice/user-7.slice/user@7.service/dbus.service",)]
    df = spark.createDataFrame(paths, "path string")
    users = spark.createDataFrame([(1000, "ann")], "uid bigint, user string")
    owned = units.owners(df)
    assert [tuple(r) for r in owned.collect()] == [(container, "/system.slice/caddy.service")]
    got = {r.path: r.unit for r in units.unit_of(df, users, owned).collect()}
    assert [got[p] for (p,) in paths] == ["sshd.service", "ann/app-x.scope", None, "db.service", "caddy.service", "caddy.service", "7/dbus.service"]


def test_times():
    now = 1_790_000_000.0
    assert times.parse_time("now", now) == now and times.parse_time("-15m", now) == now - 900 and times.parse_time("1790000000", 0) == now
    assert times.parse_time("1970-01-02", now) == 86_400 and times.parse_time("1970-01-01T00:01:05", now) == 65 and times.parse_time("1970-01-01 01:00", now) == 3600
    assert times.parse_time("00:00", 90_000) == 86_400
    for bad in ("", "25:00x", "1970-13-01", "soon", "1970-01-01:00"):
        with pytest.raises(ValueError):
            times.parse_time(bad, now)
    assert [times.parse_span(s) for s in ("90s", "15m", "2h", "1d", "7")] == [90, 900, 7200, 86_400, 7]
    assert times.parse_size("1.5G") == 3 << 29 and times.parse_size("off") is None and times.parse_size("500M") == 500 << 20
    assert times.parse_ladder("1h@180d,5m@30d") == [(300, 30 * 86_400), (3600, 180 * 86_400)]
    assert (times.resolution(7200), times.resolution(7201), times.resolution(200_000)) == (0, 300, 3600)
    assert times.moment(1234, 10, 0, 2000) == 1230 and times.moment(3000, 10, 0, 2000) is None and times.step_text(120) == "2m"
    with pytest.raises(ValueError):
        times.check_range(2, 1)
    assert math.isclose(times.parse_time("14:30", now, "Europe/Berlin") % 60, 0)
