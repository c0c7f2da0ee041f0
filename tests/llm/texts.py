"""Made-up prose."""


def words(r, n, stop="the of and to in that is was with for"):
    own = "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(3))
    return " ".join(r.choice(stop.split()) if r.random() < 0.3 else own[: r.randint(2, 6)] + "".join(r.choice("aeioubdgklmnrst") for _ in range(r.randint(2, 7))) for _ in range(n))
