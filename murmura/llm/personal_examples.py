"""Given names, and the invented sentences that the model for personal information is fitted to.

The sentences are made from frames: each frame is filled with invented persons, numbers and places of its language in
turn. Nothing here is taken from any table; no person, number, street or town exists.
"""

from __future__ import annotations

import re

#: Common given names of the six languages. Evidence among other evidence: other names are found by form and surroundings.
GIVEN_NAMES = frozenset(
    """
    anke anna andreas annika birgit bernd christian claudia daniel dieter elke erik felix florian frank franziska günter hannah hans heike heinz helga
    ingrid jan jonas julia jürgen karin katrin klaus lars laura lea lena leon lukas maja marie markus martin max mia michael mira monika nina ole paul peter
    petra sabine sandra sarah simon sophie stefan susanne sven thomas tim tobias ursula uwe wolfgang
    alice amelia arthur callum charlotte chloe edward ella emily emma evie freya george grace harry henry isla jack jacob james jessica john lily mary
    mason noah oliver olivia oscar poppy ruby sophia thea william
    bram daan eva femke finn fleur jasper jeroen julian lotte maud milan niels noor pieter ruben sanne sem sjoerd sofie tess thijs wouter
    adèle antoine bastien camille chantal claire élodie françois hugo inès jean julien jules léa louis louise lucas manon margaux mathieu nathalie nicolas pierre théo
    alejandro álvaro ana antonio carlos carmen diego elena javier jorge josé juan lucía luis manuel maría miguel nuria pablo pilar raúl sergio sofía
    алексей александр анна андрей дмитрий екатерина елена иван игорь ирина максим мария михаил наталья николай ольга павел пётр светлана сергей татьяна юлия
    """.split()
)

#: What fills the frames, by language: persons (also of names that no list holds), addresses, phone numbers, identity and account numbers.
FILLERS = {
    "de": {
        "name": "Sabine Kurzhals;Torben Wulf;Hannah Lena Borgmann;Yasemin Aktas;Nina Holt-Krämer;Reinhold Gebauer;Uwe Rabe;Swantje Immelmann;Bergfeld, Tobias;Gebauer, Wiebke;Jan Wiese;Ottokar Lenz;ursula kern;RABE, PETRA;FELIX ALTMANN;gunnar petersen".split(";"),
        "address": "Gartenstraße 12b, 20099 Neustadt;Am Hafen 5, 24103 Altstadt;Mühlenweg 7;Unter den Linden 14;Bachstr. 119, 01234 Oberdorf;Im Winkel 3a;Lindenallee 31;Schlossplatz 8, 99099 Burgau;Kirchgasse 20;An der Mauer 44, 10115 Seestadt;Alter Deich 9".split(";"),
        "phone": "0151 2345678;+49 (0)40 55512-34;0049 89 112233 4;(040) 4711-22;040 23123 55;0171/2345678;+498912345678;(0221) 4567-890".split(";"),
        "id_number": "L22X11T90;11 222 333 444;DE12 5001 0517 5407 3249 31;DE12500105175407324931;65170539M003;12345678901".split(";"),
    },
    "en": {
        "name": "Amelia Hart;Nigel Pike;Harry Oliver Stone;Winston Abara;Hart, George;Pike, Rosalind;Jack Moor-Lane;Beatrix Holloway;oscar penn;GRACE HILL;deborah finch".split(";"),
        "address": "12 Mill Lane, Newtown, ZZ1 1AB;7b Oak Street, Hillbury;144 Station Road;221 Baker Crescent;3 Priory Mews, Southby;90 Orchard Rise;18 Harbour View, Eastham, ZZ4 2CD;66 Elm Avenue".split(";"),
        "phone": "(212) 555-0111;415.555.0122;+44 1632 960111;01632 960 222;00441632960333;+1-303-555-0144".split(";"),
        "id_number": "900-12-3456;QQ 12 34 56 A;GB12 ABCD 1234 5678 9012 34;QQ123456B;901-23-4567".split(";"),
    },
    "nl": {
        "name": "Noor Visser;Teunis Brouwer;Daan Jasper Kuiper;Kuiper, Tess;Vissers, Gijsbert;Marijke Dekker;BRAM VISSER;hanneke smit".split(";"),
        "address": "Molenstraat 9a, 1234 AB Dorp;Havenkade 40;Lange Voort 12, 4321 CD Stad;Kerkplein 6;Oude Haven 77;Singel 3".split(";"),
        "phone": "0031 (0)20 5550333;06-55501234;+31 20 555 0444;06 5550 1234;020-5550199".split(";"),
        "id_number": "123456782;NL00 ABNA 0417 1643 00;NL00ABNA0417164300".split(";"),
    },
    "fr": {
        "name": "Claire Dubreuil;Thibault Marchand;Manon Petit;Petit, Jules;Garance Lenoir;Hugo Bastien Morel;MARCHAND, ODILE;yannick lebrun".split(";"),
        "address": "12b rue Pasteur, 00123 Villeneuve;8 impasse Lavoir;40 quai du Port, 00456 Bellerive;5 place Haute;17 bis, rue des Tilleuls;3 allée Verte".split(";"),
        "phone": "06 39 98 11 22;+33 6 39 98 33 44;0199001122;01 99 00 22 33".split(";"),
        "id_number": "1 84 00 75 111 222 33;184007511122233;FR00 2004 1010 0505 0001".split(";"),
    },
    "es": {
        "name": "Javier Robles;Ignacio Cuesta;Elena Robles-Mar;Robles, Pilar;Rocío Montes;diego robles;CUESTA, ITZIAR;Lucía Vega".split(";"),
        "address": "Calle Mayor, 15, 28001 Villanueva;Avenida Norte, 2;Paseo del Río, 31;Plaza Chica, 4, 00280 Villaclara;Ronda Sur 19;Camino Viejo, 8b".split(";"),
        "phone": "900 00 11 22;0034-900-000-111;+34 900 000 222;900111222".split(";"),
        "id_number": "00001234Z;XK00 1234 0000 5678 9012;00004321K".split(";"),
    },
    "ru": {
        "name": "Иван Речной;Тимур Садыков;Речная, Анна;Ольга Речная-Мост;Зарина Белова;павел мостов;МОСТОВ, ГЛЕБ;Пётр Игорь Зимин".split(";"),
        "address": "улица Новая, д. 10a, кв. 5;проспект Мира, д. 7;переулок Тихий, д. 31;ул. Полевая, д. 4, кв. 120;набережная Северная, д. 2".split(";"),
        "phone": "+7 (000) 555-11-22;8 000 555 33 44;8-000-555-4455;+70005556677".split(";"),
        "id_number": "11 22 334455;111-222-333 44;0011 №223344;1122 334455".split(";"),
    },
}
EMAILS = "felix.altmann@firma.example;altmann+info@post.example;m.rabe (at) verein (dot) example;rabe[at]verein.test;rabe_77 @ verein.invalid;NKurz@buero.example".split(";")

#: Frames: {type} is filled; a frame without one holds nothing personal.
FRAMES = {
    "de": """
        Zuständig ist {name}, Handy {phone}, am besten vormittags.
        Fragt bitte {name} ({phone}) nach dem Schlüssel.
        {name} · {phone} · {email}
        {name} · {email}
        Schickt es an {name}, {address}.
        Abgabe bei {name}, {address}. Der Verein plant ein Fest.
        Unterschrieben von {name}, {address} Der Rat prüft das.
        im Auftrag {name}, {address}
        Neue Anschrift: {address}.
        Wir sind umgezogen, jetzt {address} und sehr froh.
        Die Feier ist in der {address}.
        Morgen früh bringt {name} die Leiter vorbei.
        Vorhin war Dr. {name} hier und hat gefragt.
        Herr {name} hat den Antrag geschrieben.
        Viele Grüße {name}
        LG {name}
        MfG {name} Weiß jemand, wann das Bad öffnet?
        Ist {name} aus dem dritten Stock da, Nummer {phone}?
        ☎ {phone}
        Tel. {phone}
        Ruft mich abends an: {phone}.
        Mail an {email} oder Anruf unter {phone}.
        Überweist auf Konto {id_number}, lautend auf {name}.
        Auf das Konto {id_number} von Dr. {name} kommt das Geld.
        Personalausweis {id_number}
        Mein Ausweis hat die Nummer {id_number}, das bleibt unter uns.
        Steuernummer {id_number}
        {id_number}
        Zur Bestellung 1234-5678-9012 fehlt noch etwas.
        Bestellnummer 123-4567-8901, Lieferung am 3.4.2025.
        Eure Bestellung 951-3214-8719 liegt bereit.
        Der Zähler stand bei 1234 5678 am 10.11.2025.
        Ticket #1234/5678 ist noch nicht geschlossen.
        Version 10.392.3 wurde verteilt, 12.40.1 folgt.
        Früher 5397,90 Euro, heute 1540,50 Euro bei Lumzark.
        Der Antrag Nummer 6841 und die Linie 2771 sind Thema.
        Die Gemeinde Oberdorf und die Firma Quarzin teilen die Halle.
        Im Rathaus Neustadt liest der Chor, Eintritt 12 Euro.
        Der Verein Hafenfreunde sucht 40 Stühle und 12 Bänke.
        Am Samstag 14 Uhr zeigt das Kino Astra den Film Nordwind.
        Heute Abend spielt der Verein gegen Burgau, Beginn 18:30.
        Unsere Zeitung bringt die Liste mit 120 Fragen.
        Noch 14 Plätze im Bus, für 3500 Euro den Rasenmäher Turbo.
        Keiner kennt das Konzept namens Zarkonet aus Seestadt.
        Das Rote Kreuz und die Grüne Liste laden ein.
        Folgt @jonas_fan und https://emma.example/123456?v=7890 #Felix
        Felix kommt später, Emma und Max auch.
        Nur ein 1d10t wie du schreibt so einen Unsinn!
        Gesperrt seit 9123.88.234, nicht vor 195.5880.8380.
        Wird das im Jahr 2125.239.8675 noch etwas?
        Die Stiftung Hannah hat 12000000 Euro erhalten.
        Der Laden am Marktplatz 3000 Schritte weiter
        991074-368510-493904-480810-248648-937231-347720
        Frist verlängert auf 8159.7751.8056, sonst 195.3880.438.
        Bestellcode 8211-4402-991, Rechnung 26-1373-128.
        Der Auftrag 204-390-9280 ist storniert.
        Beim Bauhof Nord fehlt der Schlüssel für das Lager Hafen.
        Er las im Heft Wolkenzug, die Zeitung Elbblatt schrieb darüber.
        Die Bürger Altstadts und der Turnverein Burgau wollen den Platz Rosengarten.
        Laut Amt Seestadt hat das Projekt Sonnenhang Vorrang.
        Zum Thema Fahrplan Winter gab es im Saal Kastanie Streit.
        Wir sahen das Schiff Möwe am Kai Ost und das Haus Linde.
        Alle Jahre kommt der Zirkus Fantasia nach Burgau Mitte.
        Die Schule Nordhang braucht einen Antrag Stufe 3 und Formular 12.
        Es geht um Paragraf 12, Absatz 3 und Zone 4 am Tag 7.
        Ab Gleis 9 fährt Bus 44 bis Haltestelle Park 2.
        Kapitel 7 und Band 12 stehen im Raum 214.
        Die Preise der Firma Quarzin steigen.
        Ein Lkw der Spedition Ostwind kippte um.
        Am Stand der Bäckerei Kornblum gab es Brot.
        Im Werk der Gruppe Metallix brennt es.
        Das Team der Klinik Seeblick hilft der Firma Metallix.
        In der Gemeinde Sonnenau und der Stadt Burgau gilt das.
        Die Aktie der Firma Zarkonet fiel, die der Bank Nordkap stieg.
        Hat Metallix heute offen? Kann Quarzin das liefern? Soll Ostwind kommen?
        Wird Zarkonet billiger? Kommt Kornblum auch?
        Mit der Bahn Richtung Seestadt und der Linie Hafen.
        Morgen wählt die Partei Neues Ufer.
        Am Abend {name} getroffen und lange geredet.
        Dann rief {name} an.
        Zusammen mit {name} waren wir am See.
        Preis 40 Euro, Abgabe ab Freitag. Nur Montag, Dienstag und Freitag.
        Äpfel, Birnen, Kirschen: alles frisch, Anfahrt über Burgau, Seestadt, Sonnenau.
        Wohnhaft {address}
        Sie wohnt in Bad Seestadt, er zog nach Neu Burgau.
        Wir fuhren aus Alt Sonnenau nach Klein Ostheim, auf Gut Lindau war Rast.
        Beratung montags, {address}, Eingang hinten.
        Von {name} kam ein Brief, für {name} auch.
    """,
    "en": """
        Please ask {name}, mobile {phone}, about the keys.
        Has anybody seen {name} from upstairs, number {phone}?
        Send it to {name}, {address}. Our choir sings on Sunday.
        Leave the box with {name}, {address}
        Our new place is {address}.
        This morning Dr. {name} came by with a ladder.
        Mr {name} wrote the motion.
        Kind regards, {name}
        Best, {name} Is anyone in on Monday?
        Call me in the evening: {phone}.
        Tel {phone}
        Write to {email} or phone {phone}.
        {name} · {phone} · {email}
        Pay into account {id_number} in the name of {name}.
        My passport has the number {id_number}, do not pass it on.
        Social security {id_number}
        ID {id_number} A county map is on sale.
        {id_number}
        Your order 1234-5678-9012 has been packed.
        Order number 12-3456-789 is late.
        The gas meter stood at 1234 5678 in June.
        Ticket #3912/4518 is open until 24.2.2024.
        Version 10.871.3 fixes it.
        You have to kill process 3657 and start again.
        Does it close on 362.518.4400, or on 183.5061.6051?
        We have 2300 tickets and 18 seats, line 14 runs late.
        The residents of Southby watch the film Northern Light by Ostrel.
        Green Valley Trust opens a centre in Eastham.
        Grace is late and Oliver has the ticket.
        Motion number 3313 and the offer made by Zarkon are new.
        Just ring {phone} any time.
        Either mail {email} or ring {phone} then.
        Order code 8211-4402-9913 was cancelled, 775-2695-4046 was not.
        Postponed until 4876.1316.2700, no later.
        The Harbour Trust and the Eastham Gazette support Project Sunrise.
        We watched Silver Arrow at the Old Mill with the Riverside Choir.
        Take Bus 44 to Platform 9 and read Chapter 12 of Volume 3.
        Over in Southby the Village Hall has Room 14 free.
        There are 40 Chairs Left and 12 Free Tickets at Station Gate.
        Last Week the Town Band played for 30 Minutes.
        Did Metallix open? Has Quarzin closed? Will Ostwind come?
        Prices at the Company Store and the Quarzin Works went up.
        Then {name} called us.
        We went to the lake with {name} last week.
        A letter came from {name} for {name}.
        Later {name} talked about it.
        Apples, Pears, Plums on Monday, Friday and Sunday in Southby, Eastham.
        Find us at {address}, second floor.
        They moved to Great Southby and came from Little Eastham.
        We were over in New Harbour near West Quay.
        The office is now {address}.
    """,
    "nl": """
        Vraag het aan {name}, mobiel {phone}, na zessen.
        Weet iemand waar {name} woont, nummer {phone}?
        Breng het naar {name}, {address}. De fiets is weg.
        Ons nieuwe adres: {address}.
        Vanochtend kwam Dr. {name} met de sleutels.
        Hartelijke groet, {name}
        Gr. {name} Is er nog plek?
        Bel me vanavond: {phone}.
        Mijn paspoort heeft nummer {id_number}, houd dat voor je.
        Rekening {id_number} ten name van {name}.
        Mail naar {email} of bel {phone}.
        Uw bestelling 1234-5678-9012 is onderweg.
        De gasmeter gaf 1234 5678 aan in mei.
        De gemeente Dorp en bedrijf Zarkon delen lijn 2771.
        Er zijn nog 40 stoelen, 12 euro per stuk.
        Motie nummer 1676 gaat over het Oude Plein.
        Bestelnummer 8983-2383-984 is geannuleerd.
        Het nummer van de bestelling: 26-1373-128.
        Bestelling 139-5398-8839 ligt klaar, 775-2695-4046 niet.
        Je bestelnummer 8211-4402-9913 klopt niet.
        Lijn 44 rijdt tot Halte Park 2, zie Zaal 14.
        De krant Havenblad schrijft over Project Zonnig.
        Heeft Metallix open? Gaat Quarzin dicht?
        De prijzen van de Firma Quarzin stijgen in de Gemeente Zonnedal.
        Toen belde {name} ons.
        Met {name} waren we aan zee.
        Ze woont in Nieuw Duin, bij Oud Zand.
    """,
    "fr": """
        Demandez à {name}, portable {phone}, après midi.
        Quelqu'un connaît {name} du troisième, au {phone} ?
        Déposez-le chez {name}, {address}. La mairie ferme tôt.
        Notre nouvelle adresse : {address}.
        Ce matin Dr. {name} a rendu la clé.
        Cordialement, {name}
        Bises {name} Il pleut encore ?
        Appelez-moi le soir : {phone}.
        Ma carte d'identité porte le {id_number}, à garder.
        Compte {id_number} au nom de {name}.
        Un mot à {email} ou un appel au {phone}.
        Votre commande 1234-5678-9012 est prête.
        Le compteur marquait 1234 567 en mars.
        La commune de Bellerive et la société Zarkon partagent la ligne 2771.
        Il y a 40 chaises à 12 euros, motion 1676.
        Le Conseil Régional et la Croix Rouge ouvrent une salle.
        Numéro de commande 8983-2383-984, annulée.
        La commande 26-1373-128 attend, voir salle 14, quai 9.
        Le journal Port Libre et le Club Nautique soutiennent le Projet Soleil.
        Est-ce que Metallix ouvre ? Quand ferme Quarzin ?
        Les prix de la Société Quarzin montent.
        Puis {name} nous a appelés.
        Avec {name} nous étions au lac.
        On va à Belle Rive, en Haute Plaine.
    """,
    "es": """
        Preguntad a {name}, móvil {phone}, por la tarde.
        Alguien conoce a {name} del tercero, número {phone}?
        Llevadlo a {name}, {address}. La plaza está cerrada.
        Nuestra dirección nueva: {address}.
        Esta mañana vino Dr. {name} con las llaves.
        Un saludo, {name}
        Abrazos {name} Sigue lloviendo?
        Llamadme por la noche: {phone}.
        Mi pasaporte lleva el número {id_number}, guardadlo.
        Cuenta {id_number} a nombre de {name}.
        Un correo a {email} o una llamada al {phone}.
        Vuestro pedido 1234-5678-901 ya salió.
        El contador del gas iba por 1234 5678 en enero.
        El municipio de Villaclara y la firma Zarkon comparten la línea 2771.
        Quedan 40 sillas a 12 euros, moción número 1676.
        La Cruz Roja y la Liga Verde abren una sala.
        Número de pedido 8983-2383-984, anulado.
        El pedido 26-1373-128 espera, sala 14, andén 9.
        El diario Puerto Libre y el Club Náutico apoyan el Proyecto Sol.
        Abre Metallix hoy? Cierra Quarzin?
        Los precios de la Empresa Quarzin suben.
        Luego llamó {name}.
        Con {name} fuimos al lago.
        Vamos a Villa Clara, en Alta Sierra.
    """,
    "ru": """
        Спросите {name}, телефон {phone}, после обеда.
        Кто знает, где живёт {name}, номер {phone}?
        Отнесите к {name}, {address}. Школа закрыта.
        Наш новый адрес: {address}.
        Утром приходил {name} с ключами.
        Всего доброго, {name}
        Наберите меня вечером: {phone}.
        Мой паспорт {id_number}, это между нами.
        Счёт {id_number} на имя {name}.
        Пишите на {email} или звоните {phone}.
        Ваш заказ 1234-5678-9012 собран.
        Газовый счётчик показывал 1234 5678 в мае.
        Документ {id_number}
        Город Заречье и фирма Заркон делят маршрут 2771.
        Осталось 40 стульев по 12 рублей, заявление номер 6841.
        Красный Крест и Зелёная Лига открывают зал.
        Номер заказа 8983-2383-984, отменён.
        Заказ 26-1373-128 ждёт, зал 14, путь 9.
        Газета Вольный Порт и клуб Парус за проект Солнце.
        Вчера в городе Заречье Ночной Поезд опоздал.
        Открыт ли Металликс? Наша команда и Совет ждут.
        Цены фирмы Кварцин растут. Сегодня Металликс закрыт.
        Потом позвонил {name}.
        Вместе с {name} мы были у озера.
        Он живёт в Новый Ясногорск, едет из Старый Порт.
        В городе Ясногорск Наша школа открыта.
    """,
}


def _filled() -> list[str]:
    """The sentences, personal stretches as {type|stretch}; every frame with three fillings."""
    out, at = [], 0
    for lang, frames in FRAMES.items():
        for frame in filter(None, map(str.strip, frames.splitlines())):
            for _ in range(3 if "{" in frame else 1):

                def fill(m: re.Match) -> str:
                    nonlocal at
                    at += 1
                    choice = EMAILS if m[1] == "email" else FILLERS[lang][m[1]]
                    return f"{{{m[1]}|{choice[at * 7 % len(choice)]}}}"

                out.append(re.sub(r"\{(\w+)\}", fill, frame))
    # Every filling at least once.
    for lang, kinds in FILLERS.items():
        for kind, choice in kinds.items():
            frame = next(f for f in map(str.strip, FRAMES[lang].splitlines()) if f"{{{kind}}}" in f and f.count("{") == 1)
            out += [frame.replace(f"{{{kind}}}", f"{{{kind}|{x}}}") for x in choice]
    return out


def _rough() -> list[str]:
    """Harmless sentences as they come in chats: run together without a mark between them, and with a small word left out."""
    out = []
    for frames in FRAMES.values():
        plain = [f for f in map(str.strip, frames.splitlines()) if f and "{" not in f]
        for k, f in enumerate(plain):
            out.append(f.rstrip(".?!") + " " + plain[(k + 1) % len(plain)])
            small = [m.span() for m in re.finditer(r"(?<= )[^\W\d_A-ZÄÖÜА-ЯЁ]\w* ", f)]
            out += [f[:a] + f[b:] for a, b in small]
    return out


EXAMPLES = _filled()
ROUGH = _rough()
