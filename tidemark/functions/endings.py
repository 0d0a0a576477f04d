"""How processes end: wait statuses, signals, levels and the words for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import _c

# Signals 1 to 31 of Linux on x86-64 and aarch64, in order.
SIGNALS = (
    "SIGHUP SIGINT SIGQUIT SIGILL SIGTRAP SIGABRT SIGBUS SIGFPE SIGKILL SIGUSR1 SIGSEGV SIGUSR2 SIGPIPE SIGALRM SIGTERM SIGSTKFLT "
    "SIGCHLD SIGCONT SIGSTOP SIGTSTP SIGTTIN SIGTTOU SIGURG SIGXCPU SIGXFSZ SIGVTALRM SIGPROF SIGWINCH SIGIO SIGPWR SIGSYS"
).split()
FAULTS = ("SIGSEGV", "SIGBUS", "SIGILL", "SIGFPE", "SIGABRT", "SIGSYS")
#: ac_flag: never called exec; dumped core; last of its thread group. PF_KTHREAD of /proc/pid/stat.
FORKED, CORE, LAST, KERNEL_THREAD = 1, 8, 32, 0x200000


def signal_name(number) -> Column:
    n = _c(number).cast("int")
    names = F.array(*map(F.lit, SIGNALS))
    return F.when(n.between(1, 31), F.element_at(names, F.when(n.between(1, 31), n).otherwise(1))).otherwise(F.concat(F.lit("SIG"), n.cast("string")))


def signal(status) -> Column:
    return _c(status).bitwiseAND(127)


def exit_code(status) -> Column:
    """Null for a process that a signal ended."""
    return F.when(signal(status) == 0, F.shiftright(_c(status), 8).bitwiseAND(255))


def core_dumped(status, flag=None) -> Column:
    """Null for a process that exited. The wait status decides whether a signal ended it, never the flag."""
    dumped = _c(status).bitwiseAND(128) != 0
    if flag is not None:
        dumped = dumped | (_c(flag).bitwiseAND(CORE) != 0)
    return F.when(signal(status) != 0, dumped)


def status_text(status) -> Column:
    """An exit code or a signal's name."""
    return F.coalesce(exit_code(status).cast("string"), signal_name(signal(status)))


def level(status_name) -> Column:
    """Of the host, not the process: faults are errors, kills warnings, other endings but 0 (and unknown ones) notices."""
    s = _c(status_name)
    return F.when(s.isin("0", "unknown"), "info").when(s.isin(*FAULTS), "error").when(s == "SIGKILL", "warning").otherwise("notice")


def describe(status, flag=None) -> Column:
    core = F.when(core_dumped(status, flag), " (core dumped)").otherwise("")
    return F.when(signal(status) == 0, F.concat(F.lit("exited "), exit_code(status).cast("string"))).otherwise(F.concat(F.lit("killed by "), signal_name(signal(status)), core))


def span_status(status_name) -> Column:
    """ok for exit 0, error for any other code or a signal, unset for an unknown ending."""
    s = _c(status_name)
    return F.when(s == "0", "ok").when(s == "unknown", "unset").otherwise("error")


def span_ending(status_name) -> Column:
    """Words for an ending that was not well; empty for exit 0 and unknown ones."""
    s = _c(status_name)
    return F.when(s.isin("0", "unknown"), "").when(s.rlike("^[0-9]+$"), F.concat(F.lit("exited "), s)).otherwise(F.concat(F.lit("killed by "), s))


def failed(status_name) -> Column:
    """As a summary counts: any status but 0 and unknown; a missing one too."""
    return ~F.coalesce(_c(status_name), F.lit("-")).isin("0", "unknown")


def is_kernel_thread(flags) -> Column:
    return _c(flags).bitwiseAND(KERNEL_THREAD) != 0
