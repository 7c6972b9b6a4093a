import random

from tidegrid.llm import license_scan


def test_two_licences_in_one_line():
    model = license_scan.trained()
    rng = random.Random(9)
    filler = lambda n: " ".join("".join(rng.choice(("ka", "lo", "ren", "ti", "su")) for _ in range(3)) for _ in range(n))
    mit, apache, other = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under the Foobar License, version 2."
    for gap in (0, 3, 50, 400):
        found = [(f, sure) for _, f, _, _, sure in license_scan.findings(f"{filler(gap)} {mit} {filler(gap)} {apache} {filler(gap)}", model)]
        assert found == [("mit", True), ("apache-2.0", True)], (gap, found)
    for gap in (50, 400):
        found = [f for _, f, _, _, _ in license_scan.findings(f"{mit} {filler(gap)} {other}", model)]
        assert found == ["mit", "unknown"], (gap, found)
