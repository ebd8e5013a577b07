"""Sentences for measuring the models of ``pii``: forms, names and numbers that the training grammar doesn't hold."""

import random

GIVEN = "Bogdan Rajesh Svetlana Zbigniew Oluwaseun Siobhan Thandiwe Nguyet Kwame Ayesha Dragana Miroslav Ewelina Gustavo Heloísa Iñaki Jelena Khalid Ludmila Mbali Nikhil Oksana Parvati Quentin Rosalind Shreya Tadeusz Ulrike Vasilis Wioletta Ximena Yevgeny Zainab Agnieszka Brandon Cillian Deepak Eleni Farouk Gwendolyn Hiroshi Ilse Jarrod Kirsten Leopold Margit Nadezhda Orsolya Piotr Rukhsana Sunniva Tobias Urszula Vikram Wendel Yolanda Zoltan Brigitte Declan Eduardo".split()
SURNAME = "Petrescu Iyer Morozova Kowalczyk Adeyemi O'Sullivan Dlamini Tran Mensah Rahman Jovanović Horváth Nowak Ferreira Gonçalves Etxeberria Marković Haddad Bondarenko Nkosi Banerjee Shevchenko Krishnamurthy Lefebvre Winterbourne Chatterjee Wiśniewski Schwarzkopf Papadopoulos Zielińska Fuentes Sokolov Siddiqui Lewandowska Whitaker Gallagher Subramanian Alexiou Mansour Llewellyn Watanabe Vandenberghe McAllister Bjørnstad Liechtenstein Szabó Kuznetsova Fekete Mazur Hussain Haugen Eriksen Baranowska Chaudhary Steinmetz Delacroix Kertész Oyelaran Fitzpatrick Cavalcanti".split()
# Numbers as public descriptions of the formats print them, or of their form.
PHONE = ["07700 900123", "020 7946 0958", "+44 7700 900456", "(415) 555-2671", "212-555-0147", "+1 646 555 0199", "+49 30 901820", "089 636-48018", "+33 1 70 18 99 00", "06 39 98 12 34", "+34 912 345 678", "+39 06 6982 1234", "+91 98765 43210", "+61 491 570 156", "+31 20 123 4567", "+48 22 123 45 67", "+55 11 91234-5678", "1-800-555-0199", "+353 1 234 5678", "+81 3-1234-5678"]
ID = [("CPF", "123.456.789-09"), ("Aadhaar", "1234 5678 9012"), ("driving licence", "MORGA657054SM9IJ"), ("SSN", "078-05-1120"), ("passport", "C01X00T47"), ("national insurance number", "QQ 12 34 56 C"), ("PAN", "ABCPE1234F"), ("codice fiscale", "RSSMRA85T10A562S"), ("PESEL", "44051401359"), ("BSN", "111222333"), ("DNI", "12345678Z"), ("NIE", "X1234567L"), ("Steuer-ID", "86 095 742 719"), ("personnummer", "811228-9874"), ("social insurance number", "046 454 286"), ("passport no", "PA1234567"), ("Ausweisnummer", "T220001293"), ("tax number", "93/815/08152"), ("NHS number", "943 476 5919"), ("ITIN", "912-70-1234")]
ADDRESS = ["221 Baker Street, Marylebone", "1600 Amphitheatre Parkway, Mountain View", "350 Fifth Avenue, New York 10118", "Flat 9, 14 Kensington Gardens, London", "Unter den Eichenallee 12, 10115 Berlin", "Friedrichstraße 44, 10969 Berlin", "17 rue de Rivoli, 75001 Paris", "8 avenue Foch, 69006 Lyon", "Calle Serrano 21, Madrid", "Plaza Mayor 3, 37002 Salamanca", "PO Box 4412, Wellington", "Postfach 2210, 80331 München", "742 Evergreen Terrace, Springfield", "12 Grimmauld Place, Islington", "Via Garibaldi 9, 16124 Genova", "59 Elm Crescent, Apt 3, Dunedin"]
MAIL = ["bogdan.petrescu@univ-iasi.ro", "siobhan+news@o-sullivan.ie", "z_kowalczyk@poczta.pl", "thandi [at] mzansi [dot] co [dot] za", "nikhil(at)iitb(dot)ac(dot)in", "ELENI.P@ATHENS.GR", "kwame AT ghana DOT com", "j.doe%40example.org", "u.schwarz@tu-berlin.de", "info.desk@clinic.org"]

NAMES = [
    "{n} drafted the postmortem.", "Yesterday {n} rebooted everything.", "My colleague {n} disagrees.", "I owe {n} a coffee for that.", "Nobody but {n} could reproduce the crash.", "The slides come from {n}.", "We hired {n} in the spring.", "{n} is out of office until the 4th.", "Has anyone heard from {n}?", "Lunch with {n} got cancelled.", "Sorry, {n} already pushed a hotfix.", "The interview with {n} went well.", "{n} chairs the committee.",
    "Credit goes to {n}, who found it first.", "It was {n} who noticed the leak.", "Our landlord, {n}, called twice.", "Patient {n} arrived at nine.", "Invoice recipient: {n}", "Witness: {n}", "Kind regards from {n}", "Best wishes,\n{n}", "{n} hat den Termin verschoben.", "Bitte {n} informieren.", "Le dossier de {n} est complet.", "Hablé con {n} ayer.", "Both {n} and {m} voted against it.", "{n} married {m} last year.", "employee_name: {n}", '"customer": "{n}",',
    "{n} (she/her) presented first.", "Mentored by {n} since 2019.", "The painting is signed {n}.", "{n} lives nearby.", "Please welcome {n} to the group!", "An email by {n} explains why.", "{n} never replied to my message.", "Approval from {n} is pending.", "{n} quit.", "Interviewer: {n}; candidate: {m}",
]
DETAILS = [
    "You can text {p} any time.", "Emergency contact {p}.", "New mobile: {p}", "Fax us at {p} please.", "Her cell is {p}, but she rarely picks up.", "Customer service: {p}", "Voicemail left on {p} yesterday.", "My {i0}: {i}", "Please quote {i0} {i} in your reply.", "The form shows {i0} {i} in the first field.", "Holder of {i0} {i}.", "She typed her {i0} ({i}) into the chat.", "We live at {a} now.", "The courier left it at {a}.", "Home address: {a}", "Billing address {a}", "Her flat: {a}", "The keys are at {a}.",
    "My inbox is {e}.", "Send the photos over to {e}, thanks.", "Subscribed as {e}", "bounce: {e}", "You may also try {e} instead.",
]
NONE = [
    "Bloom Filter and Merge Sort are both linear here.", "The Spanning Tree Protocol saved us.", "Open Settings, then Network Adapters.", "Release Notes for Winter Edition", "Apache Kafka outperforms the rest.", "Red Hat and Debian agree on this.", "Grand Central Station was crowded.", "In Warsaw it rained.", "The Apollo cluster failed over.", "Version 10.4.22 of Juniper shipped.", "Great Expectations is a novel.", "Null Pointer Exception at startup.", "Machine Learning Engineer wanted.", "World Health Organization report", "Order 4471-2290-118 shipped.", "Invoice 20240117 is due.", "ISBN 978-3-16-148410-0",
    "IP 192.168.10.24 was blocked.", "The hash 5d41402abc4b2a76 differs.", "Between 2019-04-01 and 2021-12-31 nothing changed.", "Latitude 52.5200066 was logged.", "UUID 123e4567-e89b-12d3-a456-426614174000", "Batch 88123456 has 1200 items.", "Meeting Room Alpha is free.", "Python Enhancement Proposal 8", "Der Hauptspeicher der Anlage ist voll.", "Die Lieferung kam zu spät.", "Les Misérables au théâtre.", "El Niño afecta la pesca.", "Tokyo Tower is closed.", "npm install left-pad@1.3.0", "git@host.example:team/app.git", "See Appendix B, Table 12.", "Copyright Acme Corporation",
    "Total 1,234,567 rows", "HTTP Status 503 Service Unavailable", "Blue Ocean Strategy", "Quarterly Business Review", "Visual Studio Code crashed.", "SELECT Name FROM Users WHERE Id = 7",
]


def texts(n: int = 1500, seed: int = 7) -> list[tuple[str, list[tuple[str, int]]]]:
    """Texts with the (type, start) of their mentions."""
    r = random.Random(seed)

    def name():
        g, s = r.choice(GIVEN), r.choice(SURNAME)
        return r.choice([f"{g} {s}"] * 6 + [f"{g[0]}. {s}", f"{g} {r.choice('BDKLM')}. {s}", f"{g} {s}-{r.choice(SURNAME)}"])

    out = []
    for _ in range(n):
        text, spans = "", []
        for form in (r.choice(NAMES), r.choice(DETAILS), r.choice(NONE)) if r.random() < 0.5 else (r.choice(NONE), r.choice(NAMES), r.choice(DETAILS)):
            i0, i = r.choice(ID)
            values = {"n": ("name", name()), "m": ("name", name()), "p": ("phone", r.choice(PHONE)), "i0": (None, i0), "i": ("id_number", i), "a": ("address", r.choice(ADDRESS)), "e": ("email", r.choice(MAIL))}
            at = 0
            for k, piece in enumerate(form.replace("}", "{").split("{")):
                if k % 2 == 0 or piece not in values:
                    text += piece
                    continue
                kind, value = values[piece]
                if kind:
                    spans.append((kind, len(text)))
                text += value
            at += 1
            text += r.choice([" ", " ", "\n"])
        out.append((text, spans))
    return out
