"""Plain models for tests, written from the rules."""
import datetime as dt


def kept_by_two_keys(rows, fold=True):
    """Orders of the (order, name, url) rows that the two-key rule keeps: a row
    stays if no row kept before it owns its name or its non-empty URL. Names
    and URLs are one set of keys; the empty name is a key too."""
    def keys(name, url):
        pair = [(x or "").strip() for x in (name, url)]
        pair = [x.lower() for x in pair] if fold else pair
        return {pair[0], pair[1]} if pair[1] else {pair[0]}

    kept, owned = [], set()
    for order, name, url in sorted(rows, key=lambda r: r[0]):
        own = keys(name, url)
        if owned.isdisjoint(own):
            owned |= own
            kept.append(order)
    return kept


def span_days(start, end):
    """Days from start to end, both included, at least 1; None unless both are
    dates in one of the three sheet formats."""
    parsed = []
    for text in (start, end):
        day = None
        for form in ("%b %d, %Y", "%B %d, %Y", "%Y-%m-%d"):
            try:
                day = dt.datetime.strptime((text or "").strip(), form)
                break
            except ValueError:
                continue
        if day is None:
            return None
        parsed.append(day)
    return max(1, (parsed[1] - parsed[0]).days + 1)


class TrackerModel:
    """Rules of an upsert, each stated on its own:

    * a row is found by its folded name, else by its folded URL; of several
      rows with the key the lowest in the sheet; rows without a name are not found;
    * a found row's managed field takes the last non-empty value that differs
      from what the row held before the run;
    * its days follow the last input that changes a date, if they can be worked out;
    * what is not found is added under the two-key rule;
    * an input counts as an update if it differs from the row in any managed field.
    """

    def __init__(self, rows, fields):
        self.before = {r["row_id"]: r for r in rows}
        self.fields = fields
        self.places = {}
        for kind, column in (("n", "name"), ("u", "website")):
            for r in sorted(rows, key=lambda r: r["row_no"]):
                if self.fold(r["name"]) and self.fold(r[column]):
                    self.places[kind, self.fold(r[column])] = r["row_id"]

    @staticmethod
    def fold(text):
        return (text or "").strip().lower()

    def place(self, event):
        return self.places.get(("n", self.fold(event["name"]))) or self.places.get(("u", self.fold(event["website"])))

    def differing(self, event):
        held = self.before[self.place(event)]
        given = {f: (event.get(f) or "").strip() for f in self.fields}
        return {f: v for f, v in given.items() if v and v != (held[f] or "").strip()}

    def run(self, events):
        """(rows by id after the run, added (name, url) pairs, updates)."""
        events = sorted(events, key=lambda e: e["ord"])
        known = [e for e in events if self.place(e)]
        after = {i: dict(r) for i, r in self.before.items()}
        for i, row in after.items():
            own = [(e, self.differing(e)) for e in known if self.place(e) == i]
            for f in self.fields:
                row[f] = next((d[f] for _, d in reversed(own) if f in d), row[f])
            moved = [e for e, d in own if {"start_date", "end_date"} & set(d)]
            spans = [span_days(e["start_date"] or self.before[i]["start_date"], e["end_date"] or self.before[i]["end_date"])
                     for e in moved]
            row["days"] = next((s for s in reversed(spans) if s), row["days"])
        new = {e["ord"]: e for e in events if not self.place(e)}
        kept = kept_by_two_keys([(o, e["name"], e["website"]) for o, e in new.items()])
        added = [((new[o]["name"] or "").strip(), (new[o]["website"] or "").strip()) for o in kept]
        return after, added, sum(bool(self.differing(e)) for e in known)
