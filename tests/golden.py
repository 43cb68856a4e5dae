"""Eight invented packets with one planted defect each, and their truth."""

from fieldgate.config import LOCATION_FIELDS, SCALARS


def money(n):
    return f"${n:,}"


def row(i, address, city, b, c, bi, kind, year, labels=None, building=None, interruption=None):
    n = {"b": "Building", "c": "Contents", "bi": "BI", "k": "Construction", "y": "Year Built"} | (labels or {})
    return f"LOC | L{i} | {address} | {city} | {n['b']}: {building or money(b)} | {n['c']}: {money(c)} | {n['bi']}: {interruption or money(bi)} | {n['k']}:{' ' + kind if kind else ''} | {n['y']}:{' ' + str(year) if year else ''}"


def packet(id, name, received, effective, stated, rows, claims, truth_rows, tiv, tags, name_label="Named Insured", tiv_label="Total Insured Value", note="", email="Renewal as discussed.", change=None):
    incurred = sum(p + r for _, _, p, r in claims)
    texts = {
        "acord": f"APPLICATION\n{name_label}: {name}\nMailing Address: 9 Any Lane\nDate Received: {received}\nProposed Effective Date: {effective}\n{tiv_label}: {money(stated)}\nDeductible: $100,000",
        "sov": "SCHEDULE OF VALUES\n\n" + "\n".join(rows) + f"\n\nSOV Total: {money(stated)}\n{note}",
        "loss_run": "LOSS RUN\n" + "\n".join(f"CLAIM | {d} | {c} | Paid: {money(p)} | Reserved: {money(r)} | Status: Closed" for d, c, p, r in claims) + f"\nTotal Incurred: {money(incurred)}",
        "email": email,
        "endorsement": change,
    }
    scalars = dict(zip(SCALARS, (name, received, effective, stated, tiv, incurred, len(claims)), strict=True))
    return {"packet_id": id, "label": name, "edge_cases": tags, "texts": texts, "scalars": scalars, "locations": [dict(zip(LOCATION_FIELDS, r, strict=True)) for r in truth_rows]}


A, B, C = ("Salem, OR 97301", "Salem", "OR", "97301"), ("Bend, OR 97701", "Bend", "OR", "97701"), ("Bend, OR 97702", "Bend", "OR", "97702")


def place(address, where, b, c, bi, kind, year):
    return (address, *where[1:], b, c, bi, kind, year)


PACKETS = [
    packet("G-1", "Larch Cold Stores", "2026-03-02", "2026-04-01", 33_000_000, [row(1, "12 Alder Way", A[0], 15_000_000, 6_000_000, 2_000_000, "Frame", 1998), row(2, "7 Birch Road", B[0], 7_000_000, 2_000_000, 1_000_000, "Frame", 2004)],
           [("2024-01-05", "Water", 50_000, 0)], [place("12 Alder Way", A, 15_000_000, 6_000_000, 2_000_000, "Frame", 1998), place("7 Birch Road", B, 7_000_000, 2_000_000, 1_000_000, "Frame", 2004)], 33_000_000, []),
    packet("G-2", "Teasel Mills", "2026-03-05", "2026-05-01", 43_000_000, [row(1, "3 Loom Street", A[0], 20_000_000, 9_000_000, 1_000_000, "Frame", 1972, {"k": "Constr"}), row(2, "14 Bobbin Court", B[0], 5_000_000, 3_000_000, 1_000_000, "", "", {"k": "Constr"}), row(3, "5 Warp Lane", C[0], 2_000_000, 1_000_000, 1_000_000, "Frame", 1988, {"k": "Constr"})],
           [("2023-02-01", "Fire", 100_000, 0)], [place("3 Loom Street", A, 20_000_000, 9_000_000, 1_000_000, "Frame", 1972), place("14 Bobbin Court", B, 5_000_000, 3_000_000, 1_000_000, None, None), place("5 Warp Lane", C, 2_000_000, 1_000_000, 1_000_000, "Frame", 1988)], 43_000_000, ["MISSING_FIELD"],
           note="Note: L2 was bought in 2025.", email="We do not know how the Bobbin building was made; it may be older masonry. Please leave it blank."),
    packet("G-3", "Ridge Freight", "2026-02-17", "2026-04-01", 40_950_000, [row(1, "20 Hawk Ave", A[0], 8_900_000, 4_300_000, 1_100_000, "Frame", 2011), row(2, "77 Junction Parkway", B[0], 14_250_000, 9_800_000, 2_600_000, "Frame", 2016), row(3, "20 Hawk Avenue", A[0], 8_900_000, 4_350_000, 1_100_000, "Frame", 2011)],
           [("2024-02-01", "Theft", 1_000, 0)], [place("20 Hawk Ave", A, 8_900_000, 4_300_000, 1_100_000, "Frame", 2011), place("77 Junction Parkway", B, 14_250_000, 9_800_000, 2_600_000, "Frame", 2016)], 40_950_000, ["DUPLICATE_LOCATION", "HIGH_TIV"]),
    packet("G-4", "Fern Dairy", "2026-03-01", "2026-01-10", 10_000_000, [row(1, "1 Curd Street", A[0], 4_000_000, 1_000_000, 500_000, "Frame", 1990, {"y": "Yr Built"}), row(2, "2 Whey Street", B[0], 3_000_000, 1_000_000, 500_000, "Frame", 1991, {"y": "Yr Built"})],
           [("2026-03-20", "Water", 1_000, 0)], [place("1 Curd Street", A, 4_000_000, 1_000_000, 500_000, "Frame", 1990), place("2 Whey Street", B, 3_000_000, 1_000_000, 500_000, "Frame", 1991)], 10_000_000, ["INCONSISTENT_DATES"], name_label="Applicant"),
    packet("G-5", "Moss Hotels", "2026-03-01", "2026-04-10", 60_000_000, [row(1, "9 Quay Street", A[0], 50_000_000, 10_000_000, 5_000_000, "Frame", 1990)], [("2024-02-01", "Wind", 1_000, 0)], [place("9 Quay Street", A, 50_000_000, 10_000_000, 5_000_000, "Frame", 1990)], 65_000_000, ["CONFLICTING_LIMITS"], tiv_label="TIV (stated)"),
    packet("G-6", "Terrace Inns", "2026-02-01", "2026-03-01", 38_000_000, [row(1, "500 Shore Promenade", A[0], 14_200_000, 9_000_000, 4_000_000, "Frame", 1990), row(2, "6 Hill Road", B[0], 8_000_000, 2_000_000, 800_000, "Frame", 1991)], [("2024-02-01", "Wind", 1_000, 0)],
           [place("500 Shore Promenade", A, 28_200_000, 9_000_000, 4_000_000, "Frame", 1990), place("6 Hill Road", B, 8_000_000, 2_000_000, 800_000, "Frame", 1991)], 52_000_000, ["LATE_ENDORSEMENT"], change="REQUEST\nDate: 2026-02-04\nENDORSE | L1 | 500 Shore Promenade | Building: $14,200,000 -> $28,200,000 | on bind"),
    packet("G-7", "Anvil Foundry", "2026-02-10", "2027-09-01", 128_300_000, [row(1, "1 Forge Road", A[0], 90_000_000, 20_000_000, 5_000_000, "Frame", 1990), row(2, "2 Smelt Road", B[0], 8_200_000, 2_000_000, 3_100_000, "Frame", 1991, interruption="$3.1M")], [("2024-02-01", "Fire", 4_000_000, 1_000_000)],
           [place("1 Forge Road", A, 90_000_000, 20_000_000, 5_000_000, "Frame", 1990), place("2 Smelt Road", B, 8_200_000, 2_000_000, 3_100_000, "Frame", 1991)], 128_300_000, ["HEAVY_LOSS_HISTORY"]),
    packet("G-8", "Quartz Data", "2026-03-12", "2026-05-01", 112_300_000, [row(1, "2900 Ridge Rd", A[0], 41_000_000, 28_500_000, 12_000_000, "Frame", 2019), row(2, "2900 Ridge Road, Suite 100", A[0], 41_000_000, 28_500_000, 12_000_000, "Frame", 2019), row(3, "145 Point Loop", B[0], 16_700_000, 9_900_000, 4_200_000, "", "", {"b": "Bldg Val", "c": "Cont", "k": "Constr", "y": "Yr Blt"}, building="16700000")],
           [("2024-02-01", "Water", 1_000, 0)], [place("2900 Ridge Rd", A, 41_000_000, 28_500_000, 12_000_000, "Frame", 2019), place("145 Point Loop", B, 16_700_000, 9_900_000, 4_200_000, None, None)], 112_300_000, ["DUPLICATE_LOCATION", "HIGH_TIV", "MISSING_FIELD"], name_label="Insured Name (DBA)"),
]

#: Decisions and flags, as the engine's rules give them by hand.
EXPECTED = {
    "v1-regex": {"G-1": ("quote", ""), "G-2": ("decline", "GL-001,GL-002"), "G-3": ("referred", "GL-001"), "G-4": ("referred", "GL-002,GL-003"), "G-5": ("decline", "GL-001,GL-002"), "G-6": ("quote", ""), "G-7": ("referred", "GL-001,GL-002,GL-003,GL-004"), "G-8": ("referred", "GL-001,GL-002")},
    "v2-heuristic": {"G-1": ("quote", ""), "G-2": ("quote", ""), "G-3": ("referred", "GL-005"), "G-4": ("referred", "GL-003"), "G-5": ("referred", "GL-001"), "G-6": ("referred", "GL-001"), "G-7": ("decline", "GL-001,GL-003,GL-004"), "G-8": ("decline", "GL-001,GL-002,GL-005")},
}
CONFLICTS = {
    "v1-regex": {"G-3": "CF-001", "G-4": "CF-002", "G-7": "CF-001", "G-8": "CF-001"},
    "v2-heuristic": {"G-2": "CF-004", "G-3": "CF-003", "G-4": "CF-002", "G-5": "CF-001"},
}
REASONS = {
    "v1-regex": {"G-3": "UNRECONCILED", "G-4": "UNRECONCILED", "G-7": "UNRECONCILED", "G-8": "NOT_READABLE,UNRECONCILED"},
    "v2-heuristic": {"G-3": "ADJUSTMENT_DECISIVE", "G-4": "UNRECONCILED", "G-5": "UNRECONCILED", "G-6": "ADJUSTMENT_DECISIVE"},
}


def write(path):
    """The packets as a directory of texts and a truth file."""
    import json

    for p in PACKETS:
        folder = path / "packets" / p["packet_id"]
        folder.mkdir(parents=True)
        for doc, text in p["texts"].items():
            if text is not None:
                (folder / f"{doc}.txt").write_text(text.replace("\n", "\r\n") if p["packet_id"] == "G-1" else text, newline="")
    truth = {"_about": {"purpose": "metadata"}} | {p["packet_id"]: {"packetId": p["packet_id"], "label": p["label"], "edgeCases": p["edge_cases"], "notes": "", "fields": p["scalars"], "locations": p["locations"]} for p in PACKETS}
    (path / "truth.json").write_text(json.dumps(truth))
