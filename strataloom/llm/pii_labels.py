"""The small labelled table from which the personal-data model is trained: invented text with marked items.

Rows are put together by a small grammar from general phrases of seven languages: an opening, an item, what may follow,
alone, several in a line, in signatures, forms and lists, or among unrelated words, so that neither the phrase nor the item
alone gives an item away. Names come from the name-part table, from the short lists here and from syllables. Rows without
items hold what looks like one: things named after people and streets, dates, versions, catalogue and record numbers,
network addresses. Layout is disturbed as in the wild: letter case, spacing, line breaks, emphasis marks.
"""

from __future__ import annotations

import random
import re

TYPES = ("email", "phone", "id_number", "address", "name")
LABELS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
LABELLED_ROWS = 15_000

GIVEN = "Anna Maria John Peter Lucia Ahmed Fatima Wei Yuki Olga Ivan Carlos Elena Pierre Claire Hans Greta Marta Paulo Ines Kofi Amina Raj Priya Arjun Noor Omar Leila Mateo Sofia Luca Giulia Erik Ingrid Sven Tomas Katarina Jan Eva Mia Oliver Emma James Sarah Michael Linda Robert Helen David Ruth Daniel Grace George Alice Henry Clara Louis Marie Juan Rosa Diego Pilar Joao Beatriz Andreas Monika Stefan Ute Jürgen Hélène José Zoë Minh Linh Hiro Aiko Chen Ming Sanjay Deepa Kwame Zanele Tariq Samira Dmitri Svetlana Bogdan Ioana Niamh Sean Aoife Marek Agnieszka Ferenc Ilona".split()
FAMILY = "Smith Jones Brown Miller Wilson Taylor Moore Clark Lewis Walker Young King Wright Hill Green Adams Baker Nelson Carter Phillips Evans Turner Collins Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Koch Richter Klein Wolf Schröder Martin Bernard Dubois Durand Leroy Moreau Girard Lefèvre García Fernández López Sánchez Pérez Gómez Ruiz Díaz Torres Romero Rossi Russo Ferrari Esposito Bianchi Ricci Silva Santos Ferreira Pereira Oliveira Costa Almeida Jansen Bakker Visser Smit Meijer Kowalski Nowak Novák Horváth Nagy Popescu Ivanov Petrov Volkov Kim Park Lee Nguyen Tran Wang Zhang Liu Tanaka Sato Suzuki Khan Patel Singh Sharma Iyer Banerjee Okafor Mensah Diallo Haddad Rahman Cohen Levy Andersson Nilsson Hansen Larsen O'Neill O'Connor McDonald".split()
SYLLABLES = ["ka ri mo ve ta ni sol der bar len mar tin ros gal hen dor vin sel pa lu".split(), "son man berg feld ski ova ini elli ez eira mann wick ford ley ton sen ek ic ou yan".split()]
PARTICLES = ["de", "van", "von", "van der", "de la", "dos", "di", "al", "ben"]
TITLES = ["Dr", "Dr.", "Prof.", "Prof", "Mr.", "Ms.", "Mrs.", "Mx.", "Sir", "Mr", "Ms", "Miss", "Herr", "Frau", "Mme", "M.", "Sra.", "Sr.", "Señora", "Dott.", "Professor"]

#: What may stand before and after an item of a type, in several languages; the empty ones leave the item to itself.
OPEN = {
    "name": "|by|Reviewer|Professor emeritus|from|with|to|and|Dear|Hi|Hello|Patient|The patient|Our nurse|The nurse|The author|The editor|Written by|Signed by|Reported by|According to|I spoke with|We thank|Many thanks to|Attn:|Name:|Full name:|Client:|Author:|My name is|I am|This is|was told by|married to|the late|Please ask|Sincerely,\n|Best,\n|Yours,\n|Best wishes,\n|von|mit|bei|und|Sehr geehrter|Sehr geehrte|Unser Kollege|Ansprechpartner:|Gezeichnet,\n|Freundliche Grüße\n|par|avec|et|Cher|Chère|Signé par|Le docteur|Bien à vous,\n|con|por|y|Estimado|Firmado por|Atentamente,\n|La paciente|da|Gentile|Il paziente|Cordiali saluti,\n|com|Prezada|A paciente|Atenciosamente,\n|met|Geachte|Met vriendelijke groet,\n|Subject:|In memory of|Interviewed:|Contact person:",
    "email": "|at|to|Email:|E-mail:|Mail:|Write to|write me at|send it to|Reach us at|cc:|From:|To:|Reply to|or|per Mail an|an|Schreiben Sie an|courriel :|par mail à|écrivez à|correo:|escriba a|scrivi a|e-mail:|escreva para|mail naar|Questions?|my address is|contact us:|was forwarded to|the mailbox",
    "phone": "|at|on|Call|Phone:|Tel.|Tel:|Telephone|Mobile:|Cell:|Fax:|call me on|text me at|ring|or dial|my number is|can be reached on|is reachable under|reached at|Hotline:|reach the office at|unter|Telefon:|Rufen Sie|Handy:|au|Tél. :|appelez le|portable :|al|Teléfono:|llame al|móvil:|telefono:|chiamare|cell.|telefone:|ligue para|bel|the number|home|work:|left a message from",
    "id_number": "|His|Her|My|The|with|under|ID:|holder of|issued|quoted|showed|registered under|mit der|die|avec le|le numéro|con el|con|il|com o|document:|wrote down|stated|proof of identity:|has|read out|shown at the desk:",
    "address": "|at|to|from|in|Address:|Home address:|lives at|moved to|resides at|of|Ship to:|Send to|mail it to|delivered to|Office:|wohnt in der|wohnhaft|Adresse:|an die Anschrift|habite au|demeurant|Adresse :|domicilié|vive en|Dirección:|con domicilio en|abita in|Indirizzo:|residente in|mora na|Endereço:|woont aan de|near|we met at|the house at|Return to sender:",
}
CLOSE = {
    "name": "|.|,|;|:|said so|called yesterday|was admitted|asked for a copy|has approved it|will join us|, who lives nearby,|agreed|wrote the report|and the team|is on leave|hat angerufen|kommt morgen|a téléphoné|est absente|ha llamado|firmó|ha firmato|assinou|belde|(born 1960)|, MD|, PhD|'s file",
    "email": "|.|,|;|today|for details|bounced|is not monitored|if unsure|bitte|s'il vous plaît|por favor|per favore|)",
    "phone": "|.|,|;|today|after five|(office)|before noon|and ask for help|is busy|ab neun Uhr|le matin|por la tarde|di sera|during the day",
    "id_number": "|.|,|;|was checked|is on file|has expired|for verification|liegt vor|a été vérifié|fue verificado|è scaduto|foi verificado|on the form",
    "address": "|.|,|;|since May|and the door was shut|next week|is vacant|by courier|seit März|depuis mai|desde mayo|da maggio|desde maio|before moving|was demolished",
}
WORDS = "the a of and to in is was that for with on this are not it we they has had from more when after before only very new old small large first last next result table figure method sample value report page order room team plan cost week month year case test group water light city house book letter school market child river music train paper change level point line part number date file list note data model system project version update request server answer question office meeting budget contract travel summer winter garden kitchen doctor hospital clinic trial dose blood study review press journal article".split()
FOREIGN = "der die das und ist nicht mit für auf ein eine nach wurde werden bei Wert Tabelle Bericht Probe Studie Haus Woche Jahr Frage Ergebnis Verfahren Daten le la les et est pas avec pour sur une dans après rapport valeur étude semaine maison question résultat données el los las y no es con para una en después informe valor estudio semana casa resultado datos il lo gli e non per dopo valore studio settimana casa risultato o os um não depois relatório estudo resultado het een niet voor na waarde huis".split()
PROPER = "London Paris Berlin Madrid Rome Lisbon Vienna Boston Chicago Toronto Sydney Tokyo Delhi Cairo Lagos Europe Africa Asia America Monday Tuesday Friday Sunday January March June October December Christmas Easter English French German Spanish Chinese Google Linux Windows Python Oracle University Institute Ministry Parliament Senate Congress Commission Department Council Committee Hospital Museum Airport Station".split()
THINGS = "dataset corpus index score test scale method syndrome disease model law theorem effect coefficient curve award prize lecture library museum foundation institute station bridge archive collection cohort trial registry benchmark algorithm distribution estimator project group stadium school hospital".split()
TOWNS = ["Springfield", "Riverside", "Oakham", "Newport", "Ashford", "Lakewood", "Milton", "Greenville", "Sankt Georg", "Neustadt", "Altdorf", "Saint-Martin", "Villeneuve", "Santa Clara", "Villanueva", "San Marco", "Castelnuovo", "Vila Nova", "Nieuwdorp", "Port Haven"]
STEMS = "high park station church mill garden harbour victoria king queen oak elm maple cedar hill lake river west north south market school bridge castle forest".split()
DOMAIN = "mail post inbox corp acme globex office clinic lab uni city web cloud data home support example company hospital institute research".split()
ENDINGS = "com org net edu de fr es it pt nl uk io example info test invalid".split()

NEGATIVE = [
    "The {family} {thing} was used with the {family} {thing}.", "The {family}-{family} {thing} and a {thing} of {n}%.", "The {given} {family} {thing} opened in {date}.", "The {road} {thing} holds {n} items.", "A {thing} from {road} and one from {town}.", "{proper} {proper} and {proper} signed the treaty.",
    "See DOI 10.{n4}/{n3}.{n3} and ISSN {n4}-{n4}.", "ISBN 978-{n1}-{n4}-{n4}-{n1}, vol. {n2}, pp. {n3}-{n3}.", "Accession {CODE}-{n5}, lot {n4}-{n4}, trial NCT{n8}.", "Order {n8} was shipped on {date}.", "Invoice no. {n6} of {date}: {n3}.{n2} EUR.", "Record {n3}-{n4}, batch {n2}-{n5}, shelf {n3}.", "Job {n4}-{n4}-{n4} used build {n1}.{n2}.{n4}.",
    "Host {ip}:{n4} answered, {ip} did not.", "The range {n3}-{n3}-{n3} was kept, rows {n4} to {n4}.", "Version {n1}.{n1}.{n2} of {date}T{clock}:{n2}Z.", "{date} {clock} level=info rows={n},{n3} shard={n2} took {n4} ms", "{n4}\t{n2}.{n2}\t{CODE}{n1}\t{n3}", "| {n3} | {n2}.{n1}% | {CODE}{n1} | {n4} |", "p = 0.{n3}, n = {n},{n3}, 95% CI {n1}.{n2} to {n1}.{n2}",
    "Ask @{word}-{word} in the thread about {word} {n1}.{n1}.", "The columns user_id, tax_id and phone are empty in {n} rows.", "an address space of {n} pages; a phone survey of {n} homes", "Contact: [EMAIL] or [PHONE].", "[NAME] lives at [ADDRESS] and gave [ID_NUMBER].", "Write to [REDACTED_EMAIL], call <PHONE> or ask [REDACTED].", "[REDACTED_SECRET] was kept for {word}.", "Chapter {n1}. The {word} {word}", "Table {n1}: {word} and {word} in {n2} of {n3} {word}s", "Figure {n2} shows {CODE}{n1} at {n2} and {n3} days.",
    "{codes}", "{codes}", "{codes}. {Word} {word}", "{Word} {odd} {odd} {word} {odd}", "{Word} {Word}, {word} {odd}, {word} {word}.", "{odd}, {odd} {word} {odd}", "{word}: {odd}-{odd}; {word} {word}: {odd}", "{Odd}-{odd} {n1}.{n1} and {odd}-{odd} ran on {word}", "{Word} {Word}:\n{word} {odd} {word}", "{word} was not {word} to {word}, {odd} {odd} {word} it", "et l'{word} d'{odd}, qu'une {word} et l'{Word} n'a pas", "dell'{Word} e l'{odd} {word}", "{Word} {Word} {Word} {Word}, {Word} {Word} {n2}", "OF {n}, {n3} {Word}, {word}", "{odd} {odd} {odd}\n{odd} {odd}", "{script} {odd} {script} {n3} {script} {script}", "{script}{n2} {script} {CODE}{n2} {script}", "{Drug} and {drug} reduced {CODE}-{n2} by {n2}.{n1}%.", "{CODE}{n2} and {drug} {CODE}-{n1} {drug}", "- {drug}\n- {word} {word}\n- {CODE}{n1}", "{hex}", "key {hex} and token {hex} apply", "{n2} {n2} {n2} {n3} {n4} {n2} {n1}", "meet at noon at the dot of the map; the value at {word} dot {word}", "{proper} {n4}, {proper} {n4}, {proper} {n2}", "Room {n3}, floor {n1}, building {CODE}.", "Section {n1}.{n1} and Appendix {CODE} of {proper} {n4}", "{word}-{word}_{word}={n3};{word}_{word}: {n2}.{n1}", "In {date}, {proper} and {town} had {n5} and {n6} people.", "Im {proper} lag der {thing} bei {n2},{n1} %, siehe Abschnitt {n1}.", "Le {thing} de {family} et l'indice {family} valent {n2}.", "El {thing} de {family} bajó a {n2},{n1}.", "Il {thing} {family} è del {n2}%.", "O {thing} {family} subiu para {n2}.", "Der {family}-{thing} in {town}, Stand {date}.", "{Word} {Word} {Word} {Word} {n2}", "{Word} {word} {word} {Word} {word} {word}",
]


class Values:
    """Invented values; `given` and `family` make name parts."""

    def __init__(self, rng: random.Random, given, family):
        self.rng, self.table = rng, {"given": given, "family": family}

    def part(self, kind: str) -> str:
        r, x = self.rng, self.rng.random()
        if x < 0.4:
            return self.table[kind]()
        if x < 0.8:
            return r.choice(GIVEN if kind == "given" else FAMILY)
        return (r.choice(SYLLABLES[0]) + r.choice(SYLLABLES[0]) * r.randrange(2) + r.choice(SYLLABLES[1 if kind == "family" else 0])).capitalize()

    def given(self) -> str:
        return self.part("given")

    def family(self) -> str:
        return self.part("family")

    def d(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def pattern(self, form: str) -> str:
        """`form` with a digit for each 9 and a letter for each A."""
        return re.sub("[9A]", lambda m: self.d(1) if m.group() == "9" else self.letters(1), form)

    def name(self) -> str:
        r, g = self.rng, self.given()
        f = self.family() + (f"-{self.family()}" if r.random() < 0.08 else "")
        if r.random() < 0.08:
            f = f"{r.choice(PARTICLES)} {f}"
        i = self.letters(1)
        dot = r.choice([".", ".", ""])
        made = r.choices([f"{g} {f}", f"{g} {i}{dot} {f}", f"{f}, {g}", f"{i}. {f}", f"{r.choice(TITLES)} {f}", f"{r.choice(TITLES)} {g} {f}", f"{g} {f.upper()}", f"{r.choice(TITLES)} {i}. {f}", f"{g} {self.given()} {f}", f"{i}. {self.letters(1)}. {f}", f"{f}, {i}.", f"{f} {g} {self.given()}"], [9, 3, 2, 3, 4, 3, 1, 1, 2, 1, 1, 1])[0]
        return made.upper() if r.random() < 0.04 else made

    def domain(self) -> str:
        r = self.rng
        label = lambda: r.choice([r.choice(DOMAIN), self.family().lower(), r.choice(DOMAIN) + "-" + r.choice(TOWNS).split()[0].lower(), r.choice(DOMAIN) + self.d(1)])
        return ".".join([label() for _ in range(r.choice([1, 1, 1, 2, 2]))] + [r.choice(ENDINGS)])

    def email(self) -> str:
        r, g, f = self.rng, self.given().lower(), self.family().lower()
        s, n = r.choice([".", "-", "_", ""]), r.randrange(100)
        local = r.choice([f"{g}{s}{f}", f"{f}{s}{g}", f"{g}{n}", f"{g[0]}{s}{f}", f"{f}+{r.choice(WORDS)}", f"{r.choice(WORDS)}{s}{r.choice(WORDS)}", f"{g}{s}{f}{n}", f"{r.choice(DOMAIN)}", f"{g}", f"{f}{s}{r.choice(WORDS)}{s}{n}"])
        domain, kind = self.domain(), r.random()
        if kind < 0.35:
            at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" AT ", " DOT "), (" @ ", " . "), (" {at} ", " {dot} "), (" at ", ".")])
            return (local.replace(".", dot) if r.random() < 0.3 else local) + at + domain.replace(".", dot)
        address = f"{local}@{domain}"
        return f"<{address}>" if kind < 0.42 else f"mailto:{address}" if kind < 0.45 else address.upper() if kind < 0.52 else address

    def phone(self) -> str:
        forms = ["+99 (0)99 99999 999", "099 99999-999", "099/99999999", "+99 99 9999 9999", "099 9999 9999", "+99(0)99 9999 9999", "09 99 99 99 99", "+99 9 99 99 99 99", "0099.9.99.99.99.99", "+99 999 999 999", "(999) 999 9999", "(999) 999-9999", "+1 (999) 999-9999", "1-999-999-9999 ext. 999",
                 "999.999.9999", "999-999-9999", "999 999 9999", "9999999999", "+99 09 9999 9999", "+999 999 999 999", "0999 999999", "+99999999999", "09-99999999", "999 999 9999 x999", "+1 999 999 9999", "0999-999 99 99", "+99-99-9999-9999", "099 999 99 99", "999-9999", "0999 9999999", "+99 9999 999999", "(0999) 999999"]
        return self.pattern(self.rng.choice(forms))

    def id_number(self) -> str:
        r = self.rng
        ssn = r.choice(["999-99-9999", "999-99-9999", "999 99 9999"])
        quad = ["9999-9999-9999", "9999 9999 9999"]
        forms = [(["SSN", "ssn:", "SSN=", "SSN:", "social security number", "Social Security no.", "social", "my social is", "", "", ""], [ssn]), (["passport", "passport no.", "Passport number", "Passport number:", "Reisepass", "Reisepass-Nr.", "passeport n°", "pasaporte", "passaporto n.", "passaporte", "paspoort"], ["A99999999", "AA9999999", "A9999999", "999999999", "AAA999999"]),
                 (["tax id", "tax id:", "Tax-ID", "TIN", "Steuer-ID", "Steuernummer", "numéro fiscal", "NIF", "tax number"], ["99 999 999 999", "99-9999999", "999999999", "999 999 999", "99/999/99999"]), (["national id:", "National-ID=", "national identity number", "identity number:", "identity card", "ID card no.", "Personalausweis", "Personalausweis-Nr.", "Ausweisnummer", "Ausweis-Nr.", "carte d'identité", "carta d'identità", "cartão de cidadão"], ["AA99999999", "AA-999-9999", "9999-9999-9999", "A99A99999", "A9A99A999", "A99AA9A99", "99999999", "AA99999AA", "A9A99A9A9"]),
                 (["identity number:", "national identity number", "ID number", "identification no."], [*quad, "AA-999-9999", "AA99999999"]), (["DNI", "NIE", "DNI:"], ["99999999A", "A9999999A"]), (["NINO", "NI number", "National Insurance number"], ["AA 99 99 99 A", "AA999999A"]), (["codice fiscale", "C.F."], ["AAAAAA99A99A999A"]), (["numéro de sécurité sociale", "n° sécu", "NIR"], ["9 99 99 99 999 999", "9 99 99 99 999 999 99", "999999999999999"]), (["CPF", "BSN", "PESEL", "Aadhaar"], ["999.999.999-99", "999999999", "99999999999", "9999 9999 9999"]), (["driver's license", "licence no."], ["A999-9999-9999", "AAAAA999999AA9AA"])]
        words, values = forms[0] if r.random() < 0.15 else r.choice(forms)
        word = r.choice(words)
        return (f"{word}{'' if word.endswith('=') else ' '}" if word else "") + self.pattern(r.choice(values))

    def town(self) -> str:
        r = self.rng
        return r.choice([r.choice(TOWNS), r.choice(TOWNS), f"{self.d(5)} {r.choice(TOWNS)}", f"{r.choice(TOWNS)} {self.d(5)}", f"{r.choice(TOWNS)}, {self.letters(2)} {self.d(5)}", self.family(), f"{r.choice(['Upper', 'Lower', 'Old', 'Saint'])} {self.family()}"])

    def road(self) -> str:
        r, f = self.rng, self.family()
        base = r.choice([f, f, f, r.choice(STEMS).capitalize(), f"Old {r.choice(STEMS).capitalize()}", f"{r.choice('NSEW')}. {f}"])
        return f"{base} {r.choice(['Street', 'Road', 'Lane', 'Court', 'Avenue', 'Ave.', 'Ave', 'St.', 'St', 'Drive', 'Square', 'rd', 'Way', 'Close', 'Boulevard', 'Terrace', 'Place'])}"

    def address(self) -> str:
        r, f, n = self.rng, self.family(), str(self.rng.randrange(1, 2000) if self.rng.random() < 0.3 else self.rng.randrange(1, 300))
        number = n + r.choice(["", "", "", "", "a", "b"])
        tail = r.choice(["", "", f", {self.town()}", f", {self.town()}", f"\n{self.town()}", f" {self.town()}"])
        flat = r.choice(["", "", "", f"Flat {r.randrange(1, 30)}, ", f"Apt {r.randrange(1, 30)}{r.choice('ABC')}, "])
        english = [f"{flat}{number} {self.road()}{tail}", f"{number} {self.road()}{r.choice([', Apt. 4B', ', Suite 12', ' NW', ''])}{tail}", f"{number} old {f} rd"]
        romance = [f"{number}, rue {r.choice(['', 'de ', 'du ', 'des '])}{f}{r.choice(['', 's'])}{tail}", f"{number} {r.choice(['', 'bis '])}avenue {f}{tail}", f"{number} boulevard de {f}{tail}", f"{r.choice(['Calle', 'C/', 'Avenida', 'Avenida de', 'Plaza', 'Paseo'])} {f}{r.choice([' ', ', ', ' n.º '])}{number}{r.choice(['', ', 2.º B', ', 4.º A'])}{tail}", f"{r.choice(['Via', 'Piazza', 'Viale', 'Corso', 'Rua', 'Travessa', 'Largo', 'Praça'])} {f}{r.choice([' ', ', '])}{number}{tail}"]
        german = [f"{f}{r.choice(['er ', 'straße', 'strasse', 'str.', 'weg', 'allee', 'platz', 'gasse', 'straat', 'laan', '-Straße'])}".rstrip() + f" {number}{tail}", f"{f}er Straße {number}{tail}", f"Am {f}platz {number}{tail}", f"{r.choice(STEMS).capitalize()}straße {number}{tail}"]
        return r.choice(r.choice([english, english, romance, german]))

    def filler(self, slot: str) -> str:
        r = self.rng
        if slot[0] == "n" and slot[1:].isdigit():
            return self.d(int(slot[1:]))
        drug = lambda: r.choice(SYLLABLES[0]) + r.choice(SYLLABLES[0]) * r.randrange(2) + r.choice("mab tinib statin olol pril azole mycin vir cillin zepam ide ine in one ase gen".split())
        return {
            "n": lambda: str(r.choice([r.randrange(10), r.randrange(1000), r.randrange(100_000)])), "family": self.family, "given": self.given, "road": self.road, "town": lambda: r.choice(TOWNS), "thing": lambda: r.choice(THINGS), "proper": lambda: r.choice(PROPER), "word": lambda: r.choice(WORDS + FOREIGN), "Word": lambda: r.choice(WORDS + FOREIGN).capitalize(), "drug": drug, "Drug": lambda: drug().capitalize(), "CODE": lambda: self.letters(r.choice([1, 2, 3, 3])),
            "odd": self.odd, "Odd": lambda: self.odd().capitalize(), "codes": lambda: r.choice([" ", " - ", "\n- ", ", "]).join(self.letters(r.choice([2, 3])) + r.choice(["-", ""]) + self.d(r.choice([1, 2])) for _ in range(r.randrange(3, 14))), "script": lambda: "".join(chr(r.randrange(*r.choice([(0xAC00, 0xD7A3), (0x4E00, 0x9000), (0x3041, 0x3096), (0x0627, 0x064A)]))) for _ in range(r.randrange(1, 4))),
            "hex": lambda: "".join(r.choice("abcdef0123456789") for _ in range(r.randrange(8, 40))), "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "date": lambda: r.choice([f"{r.randrange(1950, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", f"{r.randrange(1, 29)} {r.choice(['May', 'June', 'October'])} {r.randrange(1950, 2030)}", str(r.randrange(1950, 2030))]), "clock": lambda: f"{r.randrange(24):02d}:{r.randrange(60):02d}",
        }[slot]()

    def odd(self) -> str:
        """A word that no list has, so that being unknown is no sign of a name."""
        r = self.rng
        word = lambda: "".join(r.choice("b c d f g h l m n p r s t v st tr pl".split()) + r.choice("a e i o u ea ou".split()) for _ in range(r.choice([1, 2, 2, 3]))) + r.choice(["", "n", "r", "s", "t", "ng", "tion", "ness", "ing", "ed", "al", "ment", "ly"])
        return word() + (r.choice(["-", "_", " "]) + word() if r.random() < 0.25 else "")

    def filled(self, template: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: self.filler(m.group(1)), template)

    def words(self, most: int) -> str:
        """Some unrelated words, now and then a sentence of them or a proper name."""
        r = self.rng
        pool = WORDS if r.random() < 0.6 else FOREIGN
        out = [r.choice(PROPER) if r.random() < 0.06 else r.choice(pool) if r.random() < 0.8 else self.filler(r.choice(["odd", "odd", "odd", "drug", "n", "n3", "script"])) for _ in range(r.randrange(most + 1))]
        if out and r.random() < 0.5:
            out[0] = out[0][0].upper() + out[0][1:]
        return "".join(w + r.choices([" ", ", ", " (", ") ", "; "], [92, 5, 1, 1, 1])[0] for w in out).rstrip(" ,;(")

    def row(self) -> list[tuple[str, str | None]]:
        """The parts of one row with their types."""
        r, parts = self.rng, []
        layout = r.random()
        if layout < 0.37:
            parts.append((self.filled(r.choice(NEGATIVE)), None))
        elif layout < 0.44:
            parts.append((self.words(24) + r.choice([".", "", "?"]), None))
        elif layout < 0.52:  # a block of contact data
            gap = r.choice(["\n", "; ", ", ", " | ", "\n", " - "])
            kinds = [k for k in ("name", "address", "id_number", "phone", "email") if r.random() < 0.6] or ["name"]
        elif layout < 0.57:  # one beside the other
            gap = r.choice([" at ", " (", " <", ", ", " or ", " and ", " or at ", " / "])
            kinds = r.choice([("name", "email"), ("name", "email"), ("name", "phone"), ("email", "phone"), ("name", "address"), ("phone", "email"), ("id_number", "address")])
        if 0.44 <= layout < 0.57:
            parts.append((r.choice(["", "", self.words(5) + " "]), None))
            for i, k in enumerate(kinds):
                parts += [(gap if i else "", None), (getattr(self, k)(), k)]
            parts.append((r.choice(["", ".", "\n", f". {self.words(8)}"]), None))
        elif layout >= 0.57:
            before = self.words(9)
            parts.append((before + r.choice([". ", " ", ": ", "\n", " "]) if before else "", None))
            for i in range(r.choice([1, 1, 1, 2, 2, 3])):
                k = r.choice(["name", "name", *TYPES])
                opening, closing = r.choice(OPEN[k].split("|")), r.choice(CLOSE[k].split("|"))
                bracket = r.random() < 0.08
                join = "" if opening.endswith("\n") or not opening else " "
                parts += [((r.choice([" ", ", ", " and ", "; ", ". ", " "]) if i else "") + opening + join + ("(" if bracket else ""), None), (getattr(self, k)(), k), (")" if bracket else "", None)]
                parts.append((closing if not closing or closing[0] in ".,;:)'" else " " + closing, None))
            after = self.words(9)
            parts.append((r.choice([". ", " ", "\n"]) + after if after else r.choice(["", "."]), None))
        return [p for p in parts if p[0]]


def disturb(rng: random.Random, parts: list[tuple[str, str | None]]) -> list[tuple[str, str | None]]:
    """The same parts in another layout; kinds of case and spacing hold for a whole row."""
    kind = rng.random()
    case = str.upper if kind < 0.07 else str.lower if kind < 0.11 else str.title if kind < 0.18 else None
    if case is not None:
        parts = [(case(t), k) for t, k in parts]
    kind = rng.random()
    if kind < 0.16:
        gap = rng.choice(["\n", "  ", "\t", " ", " \n", " ", "\r\n"])
        parts = [(re.sub(" ", lambda m: gap if rng.random() < 0.4 else " ", t), k) for t, k in parts]
    elif kind < 0.22:
        parts = [(re.sub(r"[^\W\d_]{3,}", lambda m: rng.choice(["**{}**", "_{}_", "{}"]).format(m.group()) if rng.random() < 0.3 else m.group(), t), k) for t, k in parts]
    elif kind < 0.26:
        parts = [(t if k else re.sub(r"[.,;:()]", "", t), k) for t, k in parts]
    return parts


def labelled_rows(given: list[str], family: list[str], rows: int = LABELLED_ROWS, seed: int = 7):
    """(parts of text with their type or None), one list for each row."""
    rng = random.Random(seed)
    values = Values(rng, lambda: rng.choice(given), lambda: rng.choice(family))
    return [disturb(rng, values.row()) for _ in range(rows)]
