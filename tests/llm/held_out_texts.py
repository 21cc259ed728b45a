"""Texts with personal information, written without looking at the operator's word lists, to measure its recall on.

Items stand between ⟦kind: and ⟧. The first list is for looking at what is missed, the second only for measuring."""

SEEN = [
    "Yesterday ⟦name:Maria Lopez⟧ went home without her inhaler.",
    "Then ⟦name:Ulrika Huldley⟧ took her pills and slept.",
    "My therapist ⟦name:Jonas Reiter⟧ said hi.",
    "We spoke with ⟦name:Priya Raman⟧ about the new dose.",
    "⟦name:Oliver Stanton⟧ has been coughing since Monday.",
    "The appointment was moved by ⟦name:Hannah Weiss⟧, see her mail ⟦email:h.weiss@praxis-nord.example⟧.",
    "If nobody answers, try ⟦phone:(415) 555-0132⟧ or my office line ⟦phone:415-555-0177⟧.",
    "Her dentist ⟦name:Paulo Mendes⟧ pulled the tooth.",
    "Parcel for the monitor goes to ⟦address:17 Linden Avenue⟧, second door.",
    "Passport ⟦id_number:X4471902⟧ was copied at the desk.",
    "Please tell ⟦name:Greta Olsson⟧ that the sample arrived.",
    "My SSN is ⟦id_number:512-44-9087⟧ in case billing asks.",
    "Last night ⟦name:Tomasz Zielinski⟧ fainted in the kitchen.",
    "I swapped shifts with ⟦name:Dana Whitfield⟧ and felt dizzy.",
    "You can reach me at ⟦phone:555-0143⟧ after six.",
]
MEASURED = [
    "After the walk ⟦name:Erik Lindqvist⟧ complained of chest tightness.",
    "This morning ⟦name:Amina Yusuf⟧ measured 128 over 82.",
    "My physiotherapist ⟦name:Carla Bianchi⟧ showed me two stretches.",
    "Our neighbour ⟦name:Walter Hoskins⟧ found me on the stairs.",
    "The swelling was noticed by ⟦name:Fiona McTavish⟧ first.",
    "⟦name:Noor Haddad⟧ forgot the evening tablet again.",
    "Later ⟦name:Samuel Okafor⟧ checked my sugar, it was 6.1.",
    "I told ⟦name:Ingrid Solberg⟧ about the rash.",
    "Meanwhile ⟦name:Peter van Dijk⟧ drove us to the clinic.",
    "My colleague ⟦name:Lucia Ferrari⟧ also has migraines.",
    "Handed the diary to ⟦name:Robert Ames⟧ on Friday.",
    "⟦name:Dr Helen Kaur⟧ thinks the headaches come from stress.".replace("⟦name:Dr ", "Dr ⟦name:"),
    "Prescribed by Dr. ⟦name:Anton Gruber⟧ in March.",
    "Frau ⟦name:Brigitte Vogel⟧ hat angerufen.",
    "Signed, ⟦name:Theodore Banks⟧",
    "Her coach ⟦name:Mei Tanaka⟧ suggested rest days.",
    "Feeling fine. ⟦name:Julia Brandt⟧ will visit tomorrow.",
    "Today ⟦name:Carlos Ibarra⟧ brought the new meter.",
    "Write to ⟦email:lena.fuchs92@mailbox.example.org⟧ with the result.",
    "Contact: ⟦email:o'neil_k@clinic-west.example⟧",
    "Send scans to ⟦email:archive [at] labhub.example⟧ please.",
    "Mobile ⟦phone:0171 2345678⟧, evenings only.",
    "Ring ⟦phone:+1 212 555 0198⟧ if the pump alarms.",
    "Fax them at ⟦phone:(020) 7946 0991⟧ today.",
    "My number is ⟦phone:303.555.0166⟧ now.",
    "Call ⟦phone:555-0119⟧ when you are outside.",
    "Medical record number ⟦id_number:MR-0092231⟧ is on the band.",
    "Insurance member id: ⟦id_number:KXZ889120034⟧.",
    "Driver's license ⟦id_number:D5512-7788⟧ shown at check-in.",
    "Social security number ⟦id_number:431-20-6655⟧ given by phone.",
    "Policy no. ⟦id_number:77-120-9934⟧ covers physiotherapy.",
    "I moved to ⟦address:204 Maple Street, Apt 3⟧ in May.",
    "Nurse comes to ⟦address:9 Harbour Road⟧ at ten.",
    "Wohnt jetzt in der ⟦address:Gartenstraße 12⟧.",
    "Deliver insulin to ⟦address:1450 W Sunset Boulevard⟧.",
]
#: Nothing here is an item.
NOTHING = [
    "The Valsalva Manoeuvre stopped the palpitations.", "Crohn Disease was ruled out in Spring.", "Took Vitamin D and Omega Three after lunch.", "Parkinson and Alzheimer screening were normal.", "Ringer Lactate was given twice.",
    "Walked Pine Ridge Trail for 40 minutes.", "Blood pressure 118/76, pulse 64.", "Lot 4471-22 of the test strips expired.", "The Glasgow Coma Scale was 15.", "Room 12 North Wing has no window.", "Apple Watch showed 52 bpm.", "Slept 7 hours 20 minutes, spo2 96.",
    "Old Town Clinic closed at noon.", "Hodgkin Lymphoma runs in the family.", "Started Keto Plan on 2024-03-01.", "The Bell Palsy got better.", "Version 3.2.1 of the app crashed at 10:45.", "Ran the City Marathon in 4 hours.",
]
