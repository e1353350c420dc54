"""Column functions over dates: limits, compliance and amendment windows. `as_of` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows in days after a change.
NEAR_CHANGE_DAYS, NEAR_ANNULMENT_DAYS = 183, 366
#: The forms of the units of periods.
UNIT_FORMS = {
    "gün": "gün günlük günü güne günde günden gündür",
    "hafta": "hafta haftalık haftası haftaya haftada haftadan haftadır",
    "ay": "ay aylık ayı aya ayda aydan aydır",
    "yıl": "yıl yıllık yılı yıla yılda yıldan yıldır",
    "iş günü": "günü günlük",
}
#: Number words.
ONES = ("", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz")
TENS = ("", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan")
#: Words that a number under a thousand has at most.
NUMBER_WORDS = 4


def business_days_after(start: Column, n: Column) -> Column:
    """The n-th working day (n of 1 or more) after start: weekends are stepped over in closed form."""
    day = F.weekday(start)
    from_friday = F.date_sub(start, F.greatest(F.lit(0), day - 4).cast("int"))
    at, rest = F.least(day, F.lit(4)), n % 5
    days = F.floor(n / 5) * 7 + rest + F.when(at + rest > 4, 2).otherwise(0)
    return F.date_add(from_friday, days.cast("int"))


def last_day(start: Column, amount: Column, unit: Column) -> Column:
    """Last day of a limit. Months and years end on the matching day, or on the month's last."""
    return (
        F.when(unit == "gün", F.date_add(start, amount.cast("int"))).when(unit == "hafta", F.date_add(start, (amount * 7).cast("int")))
        .when(unit == "iş günü", business_days_after(start, amount)).when(unit == "ay", F.add_months(start, amount.cast("int"))).when(unit == "yıl", F.add_months(start, (amount * 12).cast("int")))
    )


def check_deadline(start: Column, amount: Column, unit: Column, act: Column) -> Column:
    """last, in_time (null without an act, or with one before the start) and whether the last day is in a weekend."""
    last = last_day(start, amount, unit)
    return F.struct(last.alias("last"), F.when(act >= start, act <= last).alias("in_time"), (F.weekday(last) >= 5).alias("weekend"))


def assess(event_type: Column, change_date: Column, effective_from: Column, when: Column) -> Column:
    """changed_after, near_change or null for a change and the date of a case."""
    window = F.when(event_type == "annulled", NEAR_ANNULMENT_DAYS).otherwise(NEAR_CHANGE_DAYS)
    dated = F.when(when < change_date, "changed_after").when(F.datediff(when, change_date) < window, "near_change")
    return F.when(effective_from.isNotNull(), F.when(when < effective_from, "changed_after")).otherwise(dated)


def spelled(n: int) -> str:
    """A number under a thousand in words, written together."""
    hundreds, rest = divmod(n, 100)
    return (ONES[hundreds] if hundreds > 1 else "") + ("yüz" if hundreds else "") + TENS[rest // 10] + ONES[rest % 10]


def number_before(words: Column, at: Column) -> Column:
    """The number that the words before a place (of an array, from 1) state in digits or words: the longest that makes one."""
    known = F.create_map(*(F.lit(x) for n in range(1, 1000) for x in (spelled(n), n)))
    together = lambda n: F.when(at > n, F.array_join(F.slice(words, at - n, F.lit(n)), ""))
    digits = F.get(words, at - 2).try_cast("int")
    return F.coalesce(digits, *(known[together(n)] for n in range(NUMBER_WORDS, 0, -1)))


def states_period(text: Column, amount: Column, unit: Column) -> Column:
    """Whether a folded text states the period: a number, in digits or words, before a form of the unit."""
    words = F.split(text, r"[^\p{L}\p{N}]+")
    forms = F.create_map(*(x for u, names in UNIT_FORMS.items() for x in (F.lit(u), F.array(*(F.lit(w) for w in names.split())))))
    # A working day has two words: the number stands before the first.
    skipped = F.when(unit == "iş günü", 1).otherwise(0)
    stated = lambda at: F.array_contains(forms[unit], F.get(words, at - 1)) & ((unit != "iş günü") | (F.get(words, at - 2) == "iş")) & F.coalesce(number_before(words, at - skipped) == amount, F.lit(False))
    return F.exists(F.sequence(F.lit(1), F.size(words)), stated)
