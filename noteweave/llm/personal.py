"""Personal information in free text, found and replaced by typed placeholders (problem 4).

A linear-chain conditional random field over word-shape features labels the tokens. It is trained (by forward-backward
gradients, in numpy) from a small labelled table that a rule builds out of sentence patterns; the texts are decoded by
Viterbi in numpy batches. A token's features depend on its neighbours' words and shapes only, so a label's score is a sum
of looked-up rows, one for each neighbour.

Scale: one pass without any shuffle. Segments (sentences) are decoded once per Python worker, up to `KEPT` of them, then
forgotten; digits count by their number only, so segments that differ in digits are one. The model has a fixed size
(`WIDTH` hashed rows) and is broadcast.

Cases: null, empty and blank texts hold nothing; a text of any length is read whole; redelivered rows give the same items
once; mentions are numbered in the order in which they stand; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

KINDS = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
#: Rows of the hashed feature table, labelled sentences, rounds of training, sentences in a batch, and the seed.
WIDTH, SENTENCES, EPOCHS, BATCH, SEED = 1 << 15, 8000, 5, 120, 11
#: Share of words whose identity is hidden in training, so that shapes and neighbours must do.
HIDDEN = 0.2
#: Neighbours whose features count; segments kept by a worker; tokens in a decoded batch.
AROUND, KEPT, DECODE = (-3, -2, -1, 0, 1, 2, 3), 150_000, 1 << 14

_HAN = "㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_HAN}]|[^\W\d_{_HAN}]+|\d+|[^\w\s]|_")
_BREAK = re.compile(r"[\n 。！？।](?:(?<=[。！？।])|(?<=\n)(?:[^\S\n]*\n\s*|(?=[^\S\n]*(?:[-*•·●]|\d{1,2}[.)])\s))|(?<=[^\W\d_]{4}[.!?][\n ])(?=\s*(?:[^\W\d_a-zß-ÿ]|[•*\d-])))")


# ---- the labelled table

#: Given names, and parts that a rule makes family names, streets and places of.
GIVEN = "Margaret Bjarne Sarah Tomasz John Emily Jack Olivia Lukas Sofia Carlos Pierre Giulia Marco Erik Astrid Wei Hana Kenji Ali Leila Moses Grace William Alice Robert Susan Mark Julia Ângela Æneas Íñigo Øystein Aisha André Bilel Chloé Daniel Felix Greta Hannah Helen Hugo Ingrid Ivan José Jürgen Karl Laura Lucía Maria Marta Mei Nadia Nils Oskar Paulo Peter Priya Rosa Ruth Samuel Sophie Thomas Victor Yusuf Zoë Anna Omar Elena David Fatima Jan".split()
#: Family names that are or look like words.
_FAMILIES = "Thompson Baker Green Halvorsen Smith Kowalczyk Novak Rossi Nguyen Silva Costa Moreau Lefebvre Schmidt Weber Wagner Andersen Ivanov Petrova Tanaka Khan Patel Singh Cohen Murphy Walsh Hughes Price Young King Wood Brooks Reed Cook Bell Bailey Ward Gray Hill Stone".split()
#: Ways in which a person is named.
_PERSONS = ["{F} {L}", "{F} {L}", "{F} {L}", "{F}", "{F}", "Dr. {L}", "Dr {F} {L}", "Dr {L}", "Mr {L}", "Mr. {L}", "Mrs {F} {L}", "Mrs. {L}", "Ms {L}", "Miss {F} {L}", "{i}. {L}", "{F} {i}. {L}", "{L}, {F}", "Prof. {L}", "nurse {F}", "Sister {L}", "consultant {L}", "Frau {L}", "Herr Dr. {L}", "Mme {L}", "M. {L}", "Sra. {L}", "Sr. {L}", "Dra. {L}", "Dr. {L}-{L}", "{F} {L}-{L}", "{L}", "{F} {F} {L}", "Sig.ra {L}"]
_ONSET = "b br c ch d dr f fl g gl gr h j k kl l m n p pl pr qu r s sk sp st t th tr v w z".split()
_VOWEL = "a e i o u ai ae ei ia io ou au".split()
_CODA = ["", "", "l", "n", "r", "s", "t", "x", "lk", "nd", "rt", "st"]
_FAMILY = ["sen", "ström", "ov", "enko", "mar", "hald", "etti", "kin", "ière", "ü", "açe", "wyn", "card", "ard", "ez", "el", "vel", "quist", "son", "man", "berg", "ini", "escu"]
_STREET = ["Alder", "Mill", "Kiln", "Heron", "Lantern", "Orchard", "Saddler", "Harbour", "Bramble", "Quarry", "Station", "Church", "Oak"]
_TOWN = ["dorf", "stead", "ville", "burg", "mouth", "by", "ford", "ham"]
_ILL = ["stenosis", "colitis", "fistula", "neuropathy", "infection", "oedema", "cyst", "hernia", "abscess", "anaemia", "fracture", "embolism"]
_DRUG = ["mab", "pril", "statin", "oxin", "dine", "vir", "zol"]
#: Sentence patterns with personal information; F given name, L family name, E, P, I, A the other kinds.
WITH = [
    "Handed over from {F} to {F} at 7 a.m.", "The partner, {F}, will bring the tablets.", "pt's mum {f} {l} phoned in", "pt's dad {f} {l} phoned in", "Call back on {P} or write to {E}.", "{F} rang the ward at noon; number on file {P}.",
    "Identity checked at registration ({I}).", "Signed: {i}. {L}", "Signed: {F} {L}", "The son, {F} {L}, has power of attorney.", "Dictated by {F} {L}, MD, and typed from tape.", "Lives at {A} with a small dog.",
    "Discharge letter was sent to {E}.", "{U} {F} / {I}", "Relocated to {A} last month.", "Discussed with Dr. {L} at the bedside.", "Discussed with dr {F} {L} by phone.", "{F} {L}, RN, repeated the observations.",
    "Keys are with the neighbour at {A}.", "Home address {A}; {I} on file.", "Referred by GP {L} ({E}).", "Portal login {E}, backup mobile {P}.", "Next of kin is {F} {L} (daughter), reachable on {P}.",
    "Next of kin is {F} {L}-{L} (son), reachable on {P}.", "Carer contact: {E} / {P}.", "Patient: {F} {i}. {L}, {I}.", "Patient: {F} {L}, {I}.", "Patient: {V} {U}, {I}.", "Mr. {L} asked that Mrs. {L} be informed.",
    "Bracelet checked against {I} and {I}.", "cc: {F} {L}, {A}", "Tel {P}, fax {P}.", "Consent taken by nurse {L} in the presence of {F} {L}.", "Consent taken by nurse {F} in the presence of {F} {L}.",
    "Rückfragen bitte an Frau Dr. {L}, Tel. {P}.", "Versichertennummer {N} wurde erfasst.", "Ausweis-Nr. {X} lag vor.", "Anschrift: {A}.", "Arztbrief per E-Mail an {E}.", "Die Angehörige {F} {L} wurde informiert.", "Herr {L} wurde informiert.",
    "Courrier adressé au Dr {F} {L}.", "Courrier adressé au Dr {L}.", "Mme {L} est joignable au {P}.", "Tél. {P} ; courriel {E}.", "Adresse : {A}.", "N° de sécurité sociale {N}.", "Paciente {F} {L} {L}, {I}.", "La Sra. {L} vive en {A}.",
    "Correo {E} confirmado.", "Documento {X} apresentado.", "E-mail {E} confirmado pela irmã.", "Telefone {P} confirmado.", "Reviewed with Dr. {L} and nurse {F}.", "Mrs. {L} vs. the earlier baseline: no change.", "after review by Dr. {L}.",
    "Herr {L}, {A}, wurde entlassen.", "{F} {L}, wohnhaft {A}, kam allein.", "Mobil {P}; E-Mail {E}.", "Handy {P}, Fax {P}.", "Frau {L}, wohnhaft {A}, ging heim.", "cc: {F} {L}, {A} and GP", "Patient: {L}, {F}, {I}.", "Tel. {P}, fax {P}.",
]
#: Sentence patterns without; D a disease word, G a drug, T a town, K a family name in another's place.
WITHOUT = [
    "No evidence of {d} on the repeat scan.", "{D} {d} was considered but ruled out by imaging.", "{K} syndrome was suspected by the referring team.", "{K}'s disease was ruled out.", "{K} {d} was excluded.", "Transferred from {T} General on the second day.",
    "Transferred to St. {K} Hospital for {d} repair.", "Patient admitted with chronic {D} {d} and treated with {G} 15.7 mg twice daily.", "{G} was stopped on day 19 because of nausea.", "Antibiotic therapy with {G} was continued for 9 days.",
    "Pain score fell from 10 to 1 after {G}.", "The dietitian measured the {G} schedule within 2 hours, for which fluids were given.", "Known {D} {d}, diagnosed about 6 years ago.", "The “{d} pathway” was started within 83 minutes.",
    "Device lot 83-277 was documented in the implant log.", "Device lot 52-6130 was documented in the implant log.", "Blood pressure 152/67 and pulse regular.", "Temperature was 37.0 °C on arrival.", "pH was 7.23 and lactate 6.4 mmol/l.",
    "Dose adjusted to 24 µg per hour (±29%).", "A 79 mm lesion of the left eye was noted incidentally.", "Echo showed an ejection fraction of 38%.", "Fluid balance was negative by 1200 ml over the night.", "Creatinine rose to 1.9 mg/dl before diuresis.",
    "Insulin requirement decreased steadily during admission.", "Café-au-lait spots were seen on the left wrist – unchanged.", "Medication was reconciled with the community pharmacy.", "The ward team described the {G} schedule, although stiffness was tender.",
    "Mount {K} Hospital | Ward 3B | Printed copy", "Confidential — {K} Clinic", "** St. {K} Medical Centre **", "Clinical record · {K} Infirmary · copy 2", "{Q} CLINIC   DISCHARGE RECORD", "HOSPITAL COURSE:", "PAST MEDICAL HISTORY", "VERLAUF:",
    "Der RR lag bei 186/67 mmHg, vgl. Kurve Nr. 11.", "Am 71. Tag wurde die Drainage gezogen.", "Der Patient wurde mit {D}er Entzündung stationär aufgenommen.", "Unter {G} 28,4 mg besserten sich die Beschwerden deutlich.", "Lt. Bericht vom 3. Mai bestand kein Fieber.",
    "Le traitement par {G} 37,1 mg a été bien toléré.", "Cf. compte rendu n° 68 pour le détail.", "Se administró {G} 19,6 mg cada 8 horas.", "Ver fig. 9 y la tabla núm. 4.", "Foram administrados 11,0 mg de {G} pela manhã.", "В 2019 г. перенёс операцию на левом колене.",
    "Назначен препарат VX-57 по 40 мг.", "VX-44を1日8回投与した。", "体温37.3度，血压平稳。", "Oxygen was weaned to 12 l per minute without difficulty.", "Physiotherapy assessed the patient and recommended long-term exercises.", "Before breakfast, the on-call physician observed a small {d}.",
    "Monitoring on the ward was uneventful.", "She remains afebrile and mobile with a frame.", "Follow-up in the outpatient clinic in 3 weeks.", "Family history is positive for {d} of the shoulder.", "Haemoglobin dropped by 3.9 g/dl without a bleeding source.",
    "Seen on 12.03.2021 at 14:30 in room 4021.", "Ref 0000087714797", "Lab order 20417733 was reviewed.", "Results (see lab.example.org/r.33) were normal.", "Imaging incl. CT, MRI etc. was declined.", "Vers. 2.1.7 of the pump firmware was installed.",
    "ТЕЧЕНИЕ: Рана сухая, чистая… Боли нет!", "ЖАЛОБЫ: Была ли лихорадка? Аппетит сохранён, сон спокойный.", "АД 163/99 мм рт. ст., дыхание свободное.", "Отёк уменьшился к 65-му дню. Состояние стабильное, т. е. без ухудшения.", "Выписан под наблюдение по месту жительства.",
    "ΙΣΤΟΡΙΚΟ: Η Α.Π. ήταν 143/81 mmHg. Δεν υπάρχει αλλεργία!", "Χορηγήθηκε VX-26 7,2 mg ημερησίως. Το τραύμα είναι καθαρό.", "La evolución clínica fue satisfactoria.", "Acudió a las 6 a.m. con dolor abdominal.", "A função renal está em recuperação…",
    "Âge et poids ont été vérifiés à l’entrée.", "« Je dors mal. J’ai froid », précise la patiente.", "Die Patientin gab an: „Mir ist übel. Ich möchte schlafen.“", "The night nurse charted muscle weakness.", "The stoma nurse queried shallow breathing.", "Take {G} p.o. q.d. for 68 wk.", "{d} {D} type 98", "the {K} score was 12", "Page 2 of 4", "- 1 -", "Sheet 3 Confidential — {K} Clinic", "Sheet 12 ** {K} Hospital **", "~ 3 ~", "Die Schwester wurde informiert.", "El niño respondió adecuadamente.", "A irmã acompanhou a avaliação.", "{F} test was negative.", "Discussed at the meeting on Monday.", "Please ring the ward tomorrow morning.", "Spoke to the family today.", "Transferred to {T} for rehabilitation.", "Lives in {T} with family.", "Reviewed by Cardiology and Radiology.", "Seen by the Diabetes team in March.",
    "Started on {G} and {G} on Tuesday.", "The {K} procedure was explained.", "{K} sign positive, {K} test negative.", "Copy to Medical Records.", "Signed by the ward team.", "Order number 20417733 pending.", "Batch 4471-220 used.", "Invoice 883201 was sent.", "Room 214, bed 3.", "Weight 82 kg, height 176 cm.", "HR 88, RR 16, SpO2 97%.",
    "Extension 4021 for results.", "Sodium 138, potassium 4.1.", "{T} Road Clinic was closed.", "{T} University Hospital confirmed the slot.", "English is her first language.", "She is from {T}.", "Christmas leave was agreed.", "Return to Emergency if worse.", "Grade II {d}, Stage III.", "Known to Palliative Care.", "Nurse in charge informed.", "Doctor on call paged.",
    "Consultant review tomorrow.", "Wound Care Team visited.", "{D} {d} of Sister ward.", "Mother and Father attended.", "Rezept für {G} ausgestellt.", "Frau wirkt wach und orientiert.", "Herr im Zimmer 4 schläft.", "Vu en consultation à {T}.", "Ingresó en el Hospital de {T}.", "{G} wurde abgesetzt.", "Contact Pharmacy before discharge.", "Version 3.2.1 installed on 12.04.2022.",
    "Es liegen z. B. Husten und Fieber vor.", "Bei Bedarf, d. h. nachts, Sauerstoff.", "Beschwerden wie z. B. Ödeme und Schwindel.", "Auffällig sind u. a. Übergewicht und Atemnot.", "L’état général est bon.", "L’œil droit est rouge.", "D’autres examens sont prévus.", "« J’ai mal au dos », dit-elle.", "L’abdomen est souple.", "L’épaule et l’œsophage sont normaux.",
    "O penso foi mudado.", "O dreno foi retirado ontem.", "O doente dormiu bem.", "A ferida está limpa.", "O exame foi repetido pela manhã.", "Seguirá control en consulta.", "Mejorará con reposo.", "Tolerará dieta blanda.", "MOTIVO DE INGRESO:", "EXPLORACIÓN FÍSICA", "MOTIF DE LA VISITE:", "RAISON D’ADMISSION", "QUEIXAS ATUAIS", "REASON FOR VISIT", "AUFNAHMEGRUND:", "CONDUTA E PLANO",
    "Weight 61 kg (±2 kg)…", "Height 170 cm (±1 cm).", "患者说：“腰疼。想回家。”", "医生答：“还好。”", "家属说：“放心。”护士点头。", "「眠い。」と言った。", "家属问：“能吃饭吗？”", "患者说：“我不冷。”", "La herida cerró bien.", "El drenaje se retiró.", "Los análisis son normales.", "Dieta, reposo y control.", "La F.C. era de 80 lpm.", "La T.A. era normal.", "A F.C. era de 72 bpm.", "A P.A. era normal.", "A T.A. subiu um pouco.", "Skin was warm.", "Rash on the back.", "Haut trocken, Puls regelmäßig.", "Die Laborwerte waren normal.", "Die Atmung war ruhig.", "A função pulmonar melhorou.", "A FunÃ§Ã£o pulmonar melhorou.",
    "{w} {w} {G} {w} {w}.", "{w} {w} {D} {d} {w}.", "{w} the {K} {d} {w} {w}.", "{w} {w} from {T} {w}.", "{w} {w} 4471-22 {w} {w}.", "{w} {w} {w} {w} 142/88, {w} 77.", "{w} {w} in {T} General Hospital {w}.", "{w} {w} {w} {w} {w} {w}.", "Die Werte wÃ¤hrend der Nacht.", "Proseguirá reposo.", "EVOLUÇÃO CLÍNICA", "ÚLTIMA VISITA:",
]


#: Parts of sentences with a person N (any way of naming one), by A before and B after; verbs and objects.
BEFORE = (
    "Spoke to|Spoke with|Please ring|Please call|Please contact|Message left for|Letter copied to|Copy to|Discussed with|Plan agreed with|Seen with|Handover to|Accompanied by|Brought in by|Collected by|Witnessed by|Referred to|Booked with|"
    "Signed by|Dictated by|Typed by|Met|Informed|Emailed|Under the care of|Known to|Her husband|His wife|The son|Brother|Mother|Father|Daughter|Neighbour|His friend|Sister|Carer|Key worker|GP|Surgeon:|Consultant:|Author:|"
    "Patient name:|Name:|Contact:|Emergency contact:|Next of kin:|Re:|Dear|Operated by|Assessed by|Letter from|Advice from|Call from|Visit by|With thanks to|Interpreter|Social worker|Chaplain|Physiotherapist|Our colleague|Student nurse|"
    "Ward clerk|His cousin,|Her uncle|Aunt|Porter|Her partner,|Taxi driver|Solicitor|Teacher|Landlord|Paramedic|Volunteer|Registrar|Anaesthetist|Midwife|Pharmacist|Dietitian|The wife,|Witness:|Escort:|Caller:|Sent by|Filed by|Telephone consultation with|"
    "Entretien avec|Vu par|Appel de|Besprochen mit|Gesehen von|Anruf von|Ehefrau|Sohn|Hablado con|Visto por|La esposa|O marido|Falado com|Parlato con|Overleg met"
).split("|")
AFTER = "||, speaks English|, RN, was there| filed the form| is at home| went home| today| tomorrow morning| from social services| from pharmacy| about discharge| regarding the scan| who agrees| for advice| by phone| in clinic| at the bedside| and family| before noon| on the ward| will visit| lives nearby| (daughter)| (son)| - agreed| at 10:30| on 3 May|, who is his carer| au téléphone| heute| hoy".split("|")
VERBS = "reviewed|checked|signed|saw|examined|phoned|visited|recorded|prescribed|asked about|explained|dressed|noted|confirmed|attended|ordered|collected|discussed|took over|wants|declined|arrived with|is aware of|will follow up|hat untersucht|a vu|revisó".split("|")
OBJECTS = "the ECG|the chart|the wound|the ward|the results|him overnight|the family|the plan|bloods|consent|the drain|a second opinion|the referral|den Befund|le dossier|la herida".split("|")
#: Common words that stand around personal information in no fixed order.
WORDS = (
    "the and was with for his her their our from into after before about because while again then now later only also still first last next new old same other own early late since until during kindly urgently briefly twice already soon here there home work door bed ward clinic desk office hospital team family husband wife mother father brother cousin uncle aunt friend "
    "patient lady gentleman doctor nurse porter clerk student colleague neighbour lawyer driver letter note form card copy file record number sample blood result scan visit call message question answer opinion review plan offer referral admission discharge transfer was is has had will may must can asked told gave took brought left came went met saw heard helped moved shows says uses wants agreed declined arrived attended planned booked handed faxed replied sent present satisfied"
).split()
TIMES = "|| today| this morning| after lunch| at noon| on Monday| yesterday evening| in March| before discharge| at 6 p.m.".split("|")
#: What stands before and after telephone numbers, mail addresses, identity numbers and street addresses.
AROUND_PHONE = ("Tel|Tel.|Phone|Mobil|Handy|Fax:|Mobile:|Call|Ring|Reach the wife at|Reach him on|Contact number|Fax|Text|Reachable on|Cell|Home phone|Work number|His number is|She can be called on|Telefon|Téléphone|Teléfono|Tlf.|τηλ.|тел.|電話|Daughter's phone".split("|"), "| after six| before noon| any time| if worse| for results| (daughter)| or leave a message| (home)|, ask for ward 4".split("|"))
AROUND_EMAIL = ("Email|E-mail:|Write to|Send to|Results to|Mail|Contact|Copy by email to|Reports go to|Correo|Courriel|Address for letters:|She gave".split("|"), "| please| instead| (work)| and by post| for the report".split("|"))
AROUND_ID = ("Health card|Insurance number|Social security number|Passport|Passport no.|ID card|Hospital number|Patient ID|NHS number|MRN|Member ID|Policy no.|Driving licence|National ID|Personalausweis|Versichertennr.|CPF|NIF|DNI|Numéro de sécurité sociale|ИНН|СНИЛС|ΑΜΚΑ|保険証番号|Identity no.|Medicare no.|Tax ID".split("|"), "| verified| on file| checked| was copied| seen| matches the wristband| confirmed at the desk".split("|"))
AROUND_ADDRESS = ("Lives at|Sent home to|Taken to|Posted to|Delivered to|Resident of|Address:|Home:|Discharged to|Moved to|Visit at|Parcel to|Flat at|Ambulance to|Wohnhaft|Adresse|Domicilio|Demeurant|House keys at|Found at|Letters to|Property at|Staying at".split("|"), "| since 2010| with her husband| for two years| alone| (ground floor)| until spring".split("|"))
#: Sentences around names in other scripts; N a name, and sentences without.
SCRIPTS = {
    "ru": (["Пациент {N} поступил утром.", "Осмотрен врачом {N}.", "Консультация: {N}", "Жена {N} предупреждена.", "Беседа с {N} проведена.", "{N} жалуется на боль.", "Медсестра {N} сделала перевязку.", "Лечащий врач: {N}", "Лечащий врач {N} назначил покой.", "Хирург {N} оперировал.", "Подпись: {N}", "Дочь {N} забрала выписку."],
           ["Рана заживает, отделяемого нет.", "Живот мягкий, безболезненный.", "Температура нормальная. Давление стабильное.", "Рекомендован контроль анализов через неделю.", "Пациент жалуется на слабость.", "Осмотрен хирургом и терапевтом.", "Выписан в удовлетворительном состоянии.", "Диагноз: Пневмония. Назначен Амоксициллин.", "Жена предупреждена. Жалоб нет.", "Лечение: Покой, питьё.", "Москва, Городская больница."]),
    "el": (["Ο κ. {N} εξετάστηκε σήμερα.", "Η κα {N} ενημερώθηκε.", "Ασθενής {N}, ανδρας.", "Ιατρός: {N}", "Συζήτηση με τον {N}.", "Η σύζυγος {N} τηλεφώνησε."],
           ["Ο ασθενής αναφέρει πόνο στο γόνατο.", "Η πληγή είναι καθαρή. Δεν υπάρχει πυρετός.", "Συνεχίζεται η αγωγή με Αμπικιλλίνη.", "Ο έλεγχος ήταν φυσιολογικός.", "Η ασθενής ενημερώθηκε για τα αποτελέσματα.", "Διάγνωση: Πνευμονία. Αθήνα."]),
    "zh": (["患者{N}今日入院。", "主治医生{N}查房。", "家属{N}来电。", "签名：{N}", "姓名：{N}", "护士{N}已交班。", "由{N}医生手术。", "主治医{N}が診察した。", "氏名：{N}", "{N}先生は退院した。"],
           ["患者因发热入院。", "高血压病史多年。", "黄疸消退，白细胞正常。", "伤口干燥，无红肿。", "今日复查，体温平稳。", "医生查房后调整用药。", "家属同意手术。", "患者は歩行可能である。", "金属の異物は認めない。", "体重は安定。", "主治医が診察した。", "方針を説明した。", "周囲の発赤なし。", "医嘱：休息。"]),
}
_RU = (["Иван", "Анна", "Мария", "Олег", "Сергей", "Ольга", "Пётр", "Елена", "Дмитрий", "Нина"], "бел вол гор дан жук зим кон лав мор ник орл пав рог сид том фед чер шар".split(), ["ов", "ова", "ев", "ин", "ина", "енко", "ский", "ук"])
_EL = (["Γιώργος", "Μαρία", "Νίκος", "Ελένη", "Κώστας", "Άννα", "Δημήτρης"], "Παπ Ανδρ Γεωργ Καρ Μαρκ Νικολ Σταμ Θεοδωρ".split(), ["όπουλος", "ίδης", "άκης", "άτος", "οπούλου", "ίδου"])
_ZH = ("王李张刘陈杨赵黄周吴徐孙马朱林何高罗郑梁田中山鈴佐", "伟芳娜敏静丽强磊洋艳勇杰娟涛明超霞平刚英华玉兰飞郎子美")


class _Filler:
    """Made-up values for the patterns."""

    def __init__(self, rng: random.Random):
        self.r = rng

    def person(self) -> str:
        """A pattern of how a person is named."""
        return self.r.choice(_PERSONS)

    def sentence(self) -> str:
        """A pattern with personal information put together from parts."""
        r, way = self.r, self.r.random()
        if way < 0.2:  # any words around
            some = lambda a, b: " ".join(r.choice(WORDS) for _ in range(r.randint(a, b)))
            what = r.choice((self.person(), self.person(), self.person(), "{P}", "{E}", "{J}", "{A}"))
            left, right = some(0 if what not in ("{P}", "{J}") else 2, 5), some(0, 4)
            if what in ("{P}", "{J}"):
                left += " " + r.choice(("phone", "mobile", "number is", "ring", "call", "fax to", "tel") if what == "{P}" else ("passport", "insurance number", "NHS number", "hospital number", "licence", "identity card"))
            got = f"{left[:1].upper()}{left[1:]} {what} {right}".strip()
            return got + r.choice((".", ".", "")) if r.random() < 0.85 else f"{got}, {some(1, 3)}."
        if way < 0.4:
            return f"{r.choice(BEFORE)} {self.person()}{r.choice(AFTER)}" + r.choice((".", ".", ""))
        if way < 0.6:
            who = r.choice(("", "", "", "My colleague ", "The consultant ", "Her brother ", "Nurse ", "Then "))
            return f"{who}{self.person()} {r.choice(VERBS)} {r.choice(OBJECTS)}{r.choice(TIMES)}" + r.choice((".", ".", ""))
        (a, b), kind = r.choice(((AROUND_PHONE, "{P}"), (AROUND_EMAIL, "{E}"), (AROUND_ID, "{J}"), (AROUND_ADDRESS, "{A}")))
        got = f"{r.choice(a)}{r.choice((' ', ' ', ': '))}{kind}{r.choice(b)}".replace("::", ":")
        return r.choice((got, got, f"{self.person()}, {got[:1].lower()}{got[1:]}")) + r.choice((".", ".", ""))

    def other_script(self) -> tuple[str, bool]:
        """A sentence in another script, with its name between braces, and whether it holds one."""
        r, key = self.r, self.r.choice(list(SCRIPTS))
        if r.random() < 0.45:
            return r.choice(SCRIPTS[key][1]), False
        if key == "zh":
            name = r.choice(_ZH[0]) + "".join(r.choice(_ZH[1]) for _ in range(r.choice((1, 2, 2))))
        else:
            given, stem, end = _RU if key == "ru" else _EL
            family = (r.choice(stem) + r.choice(end)).capitalize() if key == "ru" else r.choice(stem) + r.choice(end)
            initials = " " + r.choice("АВДИКМНОПС") + "." + r.choice(("", r.choice("АВИНП") + "."))
            name = r.choice((family, r.choice(given) + " " + family, r.choice(given), family + initials if key == "ru" else family))
        return r.choice(SCRIPTS[key][0]).replace("{N}", "{=" + name + "}"), True

    def syllables(self, n: int) -> str:
        return "".join(self.r.choice(_ONSET) + self.r.choice(_VOWEL) + self.r.choice(_CODA) for _ in range(n))

    def family(self) -> str:
        way = self.r.random()
        if way < 0.12:
            return self.r.choice(_FAMILIES)
        if way < 0.2:
            return self.r.choice(("O'", "O’", "Mc", "Mac", "D'", "Al-", "Van ", "de ", "Ó ")) + self.syllables(1).capitalize() + self.r.choice(("", "en", "ley", "son", "an"))
        if way < 0.25:
            return self.r.choice("ÂÆÑÉÖÅØ") + self.syllables(1) + self.r.choice(_FAMILY)
        return (self.syllables(1 if self.r.random() < 0.8 else 2) + self.r.choice(_FAMILY)).capitalize()

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def email(self) -> str:
        f, l = (re.sub(r"\W", "", x.lower()) for x in (self.r.choice(GIVEN), self.family()))
        user = self.r.choice([f"{f}.{l}", f"contact.{l}", f"{f}.{l}{self.d(1)}", f"{l}_{f}+care", f"{f[0]}{l}{self.d(2)}", f"{f}{self.d(3)}", f"{f}-{l}", l])
        host = self.r.choice(["example.org", "mail.example", "ward.invalid", "clinic.test", "post.example.net", "EXAMPLE.COM", "uni.example.edu", "hospital.org.uk", self.syllables(2) + ".com", "mail." + self.syllables(2) + self.r.choice((".de", ".fr", ".co.uk", ".net"))])
        way = self.r.random()
        return f"{user}@{host}" if way < 0.7 else f"{user} [at] {host}" if way < 0.85 else f"{user} (at) {host.replace('.', ' dot ')}"

    def phone(self) -> str:
        d = self.d
        return self.r.choice([f"555-{d(4)}", f"+1 202 555 {d(4)}", f"202.555.{d(4)}", f"(202) 555-{d(4)}", f"01632 960{d(3)}", f"+44 1632 960 {d(3)}", f"0044{d(10)}", f"+49 (0)30 / 23125-{d(3)}", f"030 23125 {d(3)}", f"+33 1 99 00 {d(2)} {d(2)}", f"01 99 00 {d(2)} {d(2)}", f"+61 2 5550 {d(4)}", f"0{d(9)}", f"{d(3)}-{d(3)}-{d(4)}", f"07{d(3)} {d(6)}", f"020 7946 0{d(3)}", f"+7 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"06 {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)}/{d(6)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"+34 {d(3)} {d(3)} {d(3)}"])

    def doc_no(self) -> str:
        return self.r.choice(["X", "P", "C"]) + self.d(7)

    def number(self) -> str:
        return self.d(self.r.choice([10, 10, 13, 9]))

    def id(self) -> tuple[str, str]:
        d, up = self.d, lambda n: "".join(self.r.choice("ABCDEFGHKLNRSTUWX") for _ in range(n))
        return self.r.choice([("SSN ", f"{d(3)}-{d(2)}-{d(4)}"), ("SSN ", d(9)), ("MRN: ", f"{d(3)}-{d(3)}-{d(3)}"), ("MRN ", d(8)), ("NHS no. ", f"{d(3)} {d(3)} {d(4)}"), ("national id ", f"{d(6)}/{d(4)}"), ("passport ", self.doc_no()), ("DNI ", d(8) + up(1)), ("insurance no. ", up(1) + d(9)), ("driving licence ", up(4) + d(6))])

    def address(self) -> str:
        r, s, n, d = self.r, self.r.choice(_STREET), str(self.r.randint(1, 240)), self.d
        town = self.syllables(1).capitalize() + r.choice(_TOWN)
        return r.choice([f"{n} {s} Lane, Apt {d(1)}, {town} {d(5)}", f"{n}b {s} Rd.", f"Flat {d(1)}, {n} {s} Gardens", f"{s} Ave. No. {n}", f"Calle {s} {n}, {d(1)}º B", f"{s}straße {n}, {d(5)} {town}", f"{n} {s} Street, {town}", f"{s} Road {n}", f"{n} rue {s}, {d(5)} {town}", f"{n}, rue du {s}, {d(5)} {town}", f"{n} {s} Grove, {town} {self.r.choice('BLSM')}{self.r.choice('SENW')}{d(1)} {d(1)}QT", f"{n} {s} Avenue", f"{n} {s} Close, {town}", f"The Flat, {n} {s} Hill, {town}", f"{s}weg {n}, {town}", f"Via {s} {n}, {d(5)} {town}", f"Rua {s}, {n}", f"Avenida {s} {n}", f"{n} {s} Drive, {town}, {d(5)}", f"{n}A {s} Court"])

    def value(self, key: str) -> list[tuple[str, str]]:
        """Text parts with their kind, '' for none."""
        name = {"F": lambda: self.r.choice(GIVEN) if self.r.random() < 0.7 else (self.syllables(1) + self.r.choice("aeio")).capitalize(), "L": self.family, "U": lambda: self.family().upper(), "V": lambda: self.r.choice(GIVEN).upper(), "f": lambda: self.r.choice(GIVEN).lower(), "l": lambda: self.family().lower(), "i": lambda: self.r.choice("ABCDEFGHKLMNOPRST")}
        if key in name:
            return [(name[key](), "NAME")]
        if key == "J":
            d, up = self.d, lambda n: "".join(self.r.choice("ABCDEFGHKLNRSTUWX") for _ in range(n))
            number = self.r.choice((self.id()[1], f"{d(4)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", up(2) + d(6), up(1) + d(8), f"{d(2)} {d(2)} {d(2)} {d(3)}", d(11), f"{up(2)} {d(2)} {d(2)} {d(2)} {up(1)}", f"{d(4)}-{d(4)}-{d(4)}"))
            return [(number, "ID_NUMBER")]
        if key == "I":
            word, number = self.id()
            return [(word, ""), (number, "ID_NUMBER")]
        if key in "EPAXN":
            return [{"E": (self.email(), "EMAIL"), "P": (self.phone(), "PHONE"), "A": (self.address(), "ADDRESS"), "X": (self.doc_no(), "ID_NUMBER"), "N": (self.number(), "ID_NUMBER")}[key]]
        plain = {"w": lambda: self.r.choice(WORDS), "D": lambda: self.syllables(2) + self.r.choice(["al", "ous", "ic", "oid", "ine", "ive"]), "d": lambda: self.r.choice(_ILL), "G": lambda: (self.syllables(1) + self.r.choice(_DRUG)).capitalize(), "T": lambda: (self.syllables(1) + self.r.choice(_TOWN)).capitalize(), "K": lambda: (self.syllables(1) + self.r.choice(["ick", "off", "ath", "ulo", "kath"])).capitalize(), "Q": lambda: (self.syllables(1) + "ick").upper()}
        return [(plain[key](), "")]


def labelled(pattern: str, fill: _Filler, personal: bool) -> tuple[list[str], list[int]]:
    """Tokens and labels of one made-up sentence; parts of a name in a row are one mention."""
    parts: list[tuple[str, str]] = []
    for lit, name, key in re.findall(r"([^{}]+)|\{=([^}]+)\}|\{(\w)\}", pattern):
        parts += [(lit, "")] if lit else [(name, "NAME")] if name else [(t, k if personal else "") for t, k in fill.value(key)]
    text, marks = "", []
    for k, (t, kind) in enumerate(parts):
        joins = kind == "NAME" and k >= 2 and parts[k - 1][0] in (" ", "-", ". ", ", ") and parts[k - 2][1] == "NAME"
        if k == 0 or kind == "" or not personal:
            t = t[:1].upper() + t[1:] if k == 0 and "mum" not in pattern and not kind and fill.r.random() < 0.9 else t
        if joins:
            marks[-1] = (marks[-1][0], len(text) + len(t), kind)
        elif kind:
            marks.append((len(text), len(text) + len(t), kind))
        text += t
    if fill.r.random() < 0.25:
        mark = fill.r.choice(["- ", "* ", "• ", "3. "])
        text, marks = mark + text, [(a + len(mark), b + len(mark), k) for a, b, k in marks]
    if fill.r.random() < 0.1 and text.endswith("."):
        text = text[:-1]
    toks, labs = [], []
    for m in _TOKEN.finditer(text):
        lab = 0
        for a, b, kind in marks:
            if a <= m.start() < b:
                lab = 1 + 2 * KINDS.index(kind) + (m.start() > a)
        toks.append(m[0]), labs.append(lab)
    return toks, labs


def _one(fill: _Filler, k: int, with_: list[str], without: list[str], parts: bool) -> tuple[list[str], list[int]]:
    """One labelled sentence: by turns from parts, from a pattern, or without personal information."""
    rng, way = fill.r, k % 10
    if parts and way < 4:
        return labelled(fill.sentence(), fill, True)
    if parts and way == 4:
        pattern, personal = fill.other_script()
        return labelled(pattern, fill, personal)
    if way < 7:
        return labelled(with_[k // 10 % len(with_)], fill, True)
    return labelled(rng.choice(without), fill, False)


def table() -> list[tuple[list[str], list[int]]]:
    rng = random.Random(SEED)
    fill, out = _Filler(rng), []
    for k in range(SENTENCES):
        got = _one(fill, k, WITH, WITHOUT, True)
        if rng.random() < 0.35:  # a neighbouring sentence in the same segment
            more = _one(fill, rng.randrange(1 << 20), WITH, WITHOUT, True)
            got = (got[0] + more[0], got[1] + more[1])
        out.append(([("\x00" + t if t[0].isalpha() and rng.random() < HIDDEN else t) for t in got[0]], got[1]))
    return out


# ---- the field


def features(token: str) -> list[str]:
    """Word, shape and ending of a token."""
    c = token[0]
    if c == "\x00":  # in training only
        return [f for f in features(token[1:]) if not f.startswith("w ") and f != "given"]
    if c.isdigit():
        return [f"0{len(token)}", "0" if len(token) < 3 else "00" if len(token) < 5 else "000"]
    if not c.isalpha():
        return [token, "punct"]
    low = token.lower()
    case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token[1:].islower() else "mixed"
    if not c.isupper() and not c.islower():
        return ["uncased", f"uncased{min(len(token), 3)}", f"w {token}"] if len(token) == 1 else ["uncased", f"uncased{min(len(token), 3)}"]
    out = [f"w {low}", f"s {case} {min(len(token), 4)}", f"e {low[-3:]}", f"e {low[-2:]}", case]
    if low in _KNOWN:
        out.append("given")
    if len(token) == 1:
        out.append("initial " + case)
    return out


_KNOWN = {g.lower() for g in GIVEN}


class Field:
    """Weights by (neighbour, hashed feature) and label, transitions, starts and ends."""

    def __init__(self):
        n = len(LABELS)
        self.w = np.zeros((len(AROUND), WIDTH, n), dtype=np.float32)
        self.t = np.zeros((n, n), dtype=np.float32)
        self.start, self.end = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
        bad = np.zeros((n, n), dtype=np.float32)
        for j in range(2, n, 2):  # an inside label follows its own kind only
            bad[:, j] = -1e4
            bad[j, j] = bad[j - 1, j] = 0
        self.bad = bad
        self.bad_start = np.array([-1e4 if j and j % 2 == 0 else 0 for j in range(n)], dtype=np.float32)
        self._rows: dict[str, int] = {"": 0}
        self._sums: np.ndarray | None = None

    @staticmethod
    def slots(token: str) -> list[int]:
        return [xxhash.xxh3_64_intdigest(f) % WIDTH for f in features(token)]

    def freeze(self) -> None:
        self._rows, self._sums = {"": 0}, np.zeros((1024, len(AROUND), len(LABELS)), dtype=np.float32)

    def learn(self, tokens: set[str]) -> None:
        """Sum the weights of new tokens, for each neighbour position, into rows of their own."""
        if len(self._rows) + len(tokens) > 400_000:
            self.freeze()
        new = [t for t in tokens if t not in self._rows]
        if not new:
            return
        slots = [self.slots(t) for t in new]
        starts = np.cumsum([0, *map(len, slots[:-1])])
        flat = np.fromiter((x for v in slots for x in v), dtype=np.int64)
        at = len(self._rows)
        while at + len(new) > len(self._sums):
            self._sums = np.concatenate([self._sums, np.zeros_like(self._sums)])
        for j in range(len(AROUND)):
            self._sums[at : at + len(new), j] = np.add.reduceat(self.w[j, flat], starts, axis=0)
        self._rows.update(zip(new, range(at, at + len(new)), strict=True))

    def emissions(self, seqs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded scores (sequence, position, label) and lengths."""
        pad, lens = max(abs(a) for a in AROUND), np.array([len(s) for s in seqs])
        ids = np.zeros((len(seqs), lens.max() + 2 * pad), dtype=np.int64)
        self.learn({x for s in seqs for x in s})
        rows = self._rows
        for k, s in enumerate(seqs):
            ids[k, pad : pad + len(s)] = [rows[x] for x in s]
        e = np.zeros((len(seqs), lens.max(), len(LABELS)), dtype=np.float32)
        for j, a in enumerate(AROUND):
            e += self._sums[ids[:, pad + a : pad + a + lens.max()], j]
        return e, lens

    def decode(self, seqs: list[list[str]]) -> list[np.ndarray]:
        """The likeliest labels by Viterbi, all sequences at once."""
        e, lens = self.emissions(seqs)
        n, length, _ = e.shape
        score = e[:, 0] + self.start + self.bad_start
        back = np.zeros((n, length, len(LABELS)), dtype=np.int8)
        step = self.t + self.bad
        final = np.where((lens == 1)[:, None], score + self.end, 0.0)
        for i in range(1, length):
            s = score[:, :, None] + step
            back[:, i] = s.argmax(axis=1)
            score = s.max(axis=1) + e[:, i]
            final[lens == i + 1] = (score + self.end)[lens == i + 1]
        at = final.argmax(axis=1)
        out = np.zeros((n, length), dtype=np.int8)
        rows = np.arange(n)
        out[rows, lens - 1] = at
        for i in range(length - 1, 0, -1):
            live = lens - 1 >= i
            prev = back[rows, i, out[:, i]]
            out[live, i - 1] = prev[live]
        return [out[k, : lens[k]] for k in range(n)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[list[str], list[int]]] | None = None) -> Field:
    """Maximum conditional likelihood by stochastic gradients with adaptive steps."""
    rows = rows if rows is not None else table()
    f = Field()
    types: dict[str, int] = {"": 0}
    for toks, _ in rows:
        for x in toks:
            types.setdefault(x, len(types))
    slots = [Field.slots(x) if x else [] for x in types]
    slots = [np.array(v, dtype=np.int64) for v in slots]
    n, pad = len(LABELS), max(abs(a) for a in AROUND)
    grads = {k: np.full_like(getattr(f, k), 1e-2, dtype=np.float32) for k in ("w", "t", "start", "end")}
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            part = [rows[k] for k in order[lo : lo + BATCH]]
            lens = np.array([len(t) for t, _ in part])
            length = int(lens.max())
            ids = np.zeros((len(part), length + 2 * pad), dtype=np.int64)
            gold = np.zeros((len(part), length), dtype=np.int64)
            for k, (t, y) in enumerate(part):
                ids[k, pad : pad + len(t)] = [types[x] for x in t]
                gold[k, : len(y)] = y
            used, local = np.unique(ids, return_inverse=True)  # the types of this batch and their slots only
            local = local.reshape(ids.shape)
            flat = np.concatenate([slots[t] for t in used])
            owner = np.repeat(np.arange(len(used)), [len(slots[t]) for t in used])
            touched, at = np.unique(flat, return_inverse=True)
            w = f.w[:, touched]
            sums = np.zeros((len(AROUND), len(used), n), dtype=np.float32)
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[:, owner[begin]] = np.add.reduceat(w[:, at], begin, axis=1)
            e = sum(sums[j, local[:, pad + a : pad + a + length]] for j, a in enumerate(AROUND))
            mask = np.arange(length)[None] < lens[:, None]
            step = f.t + f.bad
            fwd = np.zeros((len(part), length, n), dtype=np.float32)
            fwd[:, 0] = e[:, 0] + f.start + f.bad_start
            for i in range(1, length):
                new = _lse(fwd[:, i - 1, :, None] + step, 1) + e[:, i]
                fwd[:, i] = np.where(mask[:, i, None], new, fwd[:, i - 1])
            z = _lse(fwd[:, -1] + f.end, 1)
            bwd = np.zeros_like(fwd)
            bwd[:, -1] = f.end
            pair = np.zeros((n, n), dtype=np.float32)
            for i in range(length - 1, 0, -1):
                inner = e[:, i] + bwd[:, i]
                back = _lse(step[None] + inner[:, None, :], 2)
                bwd[:, i - 1] = np.where(mask[:, i, None], back, bwd[:, i])
                p = np.exp(fwd[:, i - 1, :, None] + step + inner[:, None, :] - z[:, None, None])
                pair += p[mask[:, i]].sum(axis=0)
            prob = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
            d = -prob
            d[np.nonzero(mask)[0], np.nonzero(mask)[1], gold[mask]] += 1
            g_t = -pair
            for i in range(1, length):
                live = mask[:, i]
                np.add.at(g_t, (gold[live, i - 1], gold[live, i]), 1.0)
            g_w = -1e-3 * w
            live = d[mask]
            order_ = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order_], prepend=-1))
            for j, a in enumerate(AROUND):
                by_type = np.zeros((len(used), n), dtype=np.float32)
                np.add.at(by_type, local[:, pad + a : pad + a + length][mask], live)
                g_w[j] += np.add.reduceat(by_type[owner[order_]], first, axis=0)
            last = np.zeros_like(prob[:, 0])
            last[np.arange(len(part)), gold[np.arange(len(part)), lens - 1]] = 1
            grads["w"][:, touched] += g_w * g_w
            f.w[:, touched] += 0.35 * g_w / np.sqrt(grads["w"][:, touched])
            ends = {"t": g_t - 1e-3 * f.t, "start": d[:, 0].sum(axis=0), "end": (last - prob[np.arange(len(part)), lens - 1]).sum(axis=0)}
            for k, g in ends.items():
                grads[k] += g * g
                getattr(f, k)[...] += 0.35 * g / np.sqrt(grads[k])
    f.freeze()
    return f


# ---- texts


def _sound(kind: str, text: str, before: str, after: str) -> bool:
    """An exact check of a found item: what its kind must contain at least, and that it is no part of a damaged word."""
    digits = sum(c.isdigit() for c in text)
    letters = sum(c.isalpha() for c in text)
    if kind == "EMAIL":
        return bool(re.search(r"@|[\[(]\s*at\s*[\])]", text, re.I))
    if kind == "PHONE":
        return 7 <= digits <= 16
    if kind == "ID_NUMBER":
        return digits >= 5 and text.isascii()
    if kind == "ADDRESS":
        return digits >= 1 and letters >= 3 and not re.search("[\x80-\x9f]", text) and (not _DAMAGED.search(text) or len(re.findall("[A-Za-z]", text)) >= 5)
    whole = not before or before.isspace() or before in "([\"“„«'’‘-–—/:;,.|>*•·●。）（「『：、" or (text[0] > "⺀" and before > "⺀")
    cased = not text[0].islower() or " " in text or "\n" in text
    least = 2 if text[0] < "⺀" else 1
    return letters >= least and whole and cased and not _DAMAGED.search(text) and not (after and (after.isdigit() or after in "+!@√™°≈©"))


#: What a text that was decoded wrongly holds: a lead letter and what a continuation byte is read as.
_DAMAGED = re.compile("[ÃÂÐÑÎÏâåäæçèéã][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸŒ]|�")


def _segments(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _BREAK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if b > a]


_ZERO = bytes.maketrans(b"123456789", b"000000000")


class Finder:
    """Finds items in texts and keeps what it found in segments."""

    def __init__(self, field: Field):
        self.field = field
        field.freeze()
        self.kept: dict[str, list[tuple[int, int, str]]] = {}

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        cut = []
        for t in texts:
            z = t.encode("utf-8", "surrogatepass").translate(_ZERO).decode("utf-8", "surrogatepass") if t and not t.isspace() else ""
            cut.append([(a, z[a:b]) for a, b in _segments(z)])
        if len(self.kept) > KEPT:
            self.kept = {}
        new = sorted({s for c in cut for _, s in c if s not in self.kept}, key=len)
        group, size = [], 0
        for s in new:
            spans = [(m.start(), m.end()) for m in _TOKEN.finditer(s)]
            if not spans:
                self.kept[s] = []
                continue
            if group and (size + len(spans) > DECODE or len(spans) > 1.5 * len(group[0][1]) + 8):
                self._decode(group)
                group, size = [], 0
            group.append((s, spans))
            size += len(spans)
        if group:
            self._decode(group)
        return [[(a + x, a + y, k) for a, s in c for x, y, k in self.kept[s]] for c in cut]

    def _decode(self, group: list[tuple[str, list[tuple[int, int]]]]) -> None:
        labels = self.field.decode([[s[a:b] for a, b in spans] for s, spans in group])
        for (s, spans), labs in zip(group, labels, strict=True):
            items: list[tuple[int, int, str]] = []
            if labs.any():
                for (a, b), y in zip(spans, labs, strict=True):
                    if y == 0:
                        continue
                    kind = KINDS[(y - 1) // 2]
                    if y % 2 == 0 and items:
                        items[-1] = (items[-1][0], b, kind)
                    else:
                        items.append((a, b, kind))
                items = [x for x in items if _sound(x[2], s[x[0] : x[1]], s[x[0] - 1 : x[0]] if x[0] else "", s[x[1] : x[1] + 1])]
            self.kept[s] = items


_FINDERS: dict[str, Finder] = {}


def _finder(data: tuple) -> Finder:
    """This worker's finder of a model, known by its content."""
    key = data[0]
    if key not in _FINDERS:
        _FINDERS.clear()
        f = Field()
        f.w, f.t, f.start, f.end = data[1:]
        _FINDERS[key] = Finder(f)
    return _FINDERS[key]


def _send(spark: SparkSession):
    f = train()
    return spark.sparkContext.broadcast((xxhash.xxh3_128_hexdigest(f.w.tobytes() + f.t.tobytes()), f.w, f.t, f.start, f.end))


def kinds_in(spark: SparkSession, sent=None):
    """A column function: the kinds of the items of a text, in order."""
    sent = sent or _send(spark)

    @pandas_udf(ArrayType(StringType()))
    def kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = _finder(sent.value)
        for texts in batches:
            yield pd.Series([[k for _, _, k in x] for x in f.batch(list(texts))], dtype=object)

    return kinds


def redacted(spark: SparkSession, sent=None):
    """A column function: the text with each item replaced by [KIND]."""
    sent = sent or _send(spark)

    @pandas_udf(StringType())
    def put(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = _finder(sent.value)
        for texts in batches:
            out = []
            for t, items in zip(texts, f.batch(list(texts)), strict=True):
                for a, b, k in reversed(items):
                    t = f"{t[:a]}[{k}]{t[b:]}"
                out.append(t)
            yield pd.Series(out, dtype=object)

    return put


def _both(docs: DataFrame, snippets: DataFrame) -> DataFrame:
    a = docs.select(F.lit("clinical_documents").alias("table_name"), F.col("id").alias("row_key"), "text")
    b = snippets.select(F.lit("evidence_snippets").alias("table_name"), F.col("snippet_id").alias("row_key"), F.col("quote").alias("text"))
    return a.unionByName(b).where(F.col("text").rlike(r"(?U)\S"))


def found(spark: SparkSession, docs: DataFrame, snippets: DataFrame) -> DataFrame:
    """(table_name, row_key, kind, nth) of every item."""
    kinds = kinds_in(spark).asNondeterministic()  # evaluated once, not again in the filter
    each = _both(docs, snippets).select("table_name", "row_key", kinds("text").alias("ks")).where(F.size("ks") > 0)
    counts = [F.struct(F.lit(k).alias("kind"), (F.size("ks") - F.size(F.array_remove("ks", k))).alias("n")) for k in KINDS]
    per = each.select("table_name", "row_key", F.explode(F.array(*counts)).alias("c")).where("c.n > 0").groupBy("table_name", "row_key", "c.kind").agg(F.max("c.n").alias("n"))
    return per.select("table_name", "row_key", "kind", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))


def redact(spark: SparkSession, docs: DataFrame, snippets: DataFrame) -> DataFrame:
    """(table_name, row_key, text) of all texts, with placeholders."""
    return _both(docs, snippets).select("table_name", "row_key", redacted(spark)("text").alias("text"))
