"""Curated subject terms: a general vocabulary of eight subjects in ten languages, the automaton's starting point.

Terms are lower-case words or short phrases; the weights are fitted at run time (see subjects.py).
"""

CURATED = {
    "science": """
en: hypothesis, laboratory, experiment, microscope, telescope, isotope, molecule, enzyme, genome, spectrum, particle, orbit, fossil, physics, chemistry, biology, catalyst, magnetic field
de: hypothese, labor, experiment, mikroskop, teleskop, molekül, enzym, magnetfeld, spektrum, umlaufbahn, messung, probe
fr: hypothèse, laboratoire, expérience, microscope, télescope, molécule, enzyme, champ magnétique, spectre, orbite, mesure
es: hipótesis, laboratorio, experimento, microscopio, telescopio, molécula, enzima, campo magnético, espectro, órbita, medición
it: ipotesi, laboratorio, esperimento, microscopio, telescopio, molecola, enzima, campo magnetico, spettro, orbita, misurazione
pt: hipótese, laboratório, experiência, microscópio, telescópio, molécula, enzima, campo magnético, espectro, órbita, medição
nl: hypothese, laboratorium, experiment, microscoop, telescoop, molecuul, enzym, magnetisch veld, spectrum, meting
pl: hipoteza, laboratorium, eksperyment, mikroskop, teleskop, cząsteczka, enzym, pole magnetyczne, widmo, orbita, pomiar
ru: гипотеза, лаборатория, эксперимент, микроскоп, телескоп, молекула, фермент, магнитное поле, спектр, орбита, измерение
ja: 仮説, 実験室, 実験, 顕微鏡, 望遠鏡, 分子, 酵素, 磁場, 軌道, 測定値, 試料""",
    "law": """
en: court, lawsuit, plaintiff, statute, verdict, contract, tribunal, appeal, witness, ordinance, jurisdiction, injunction, notary, attorney, liability
de: gericht, klage, urteil, vertrag, gesetz, berufung, zeuge, verordnung, klausel, anwalt, richter
fr: tribunal, procès, verdict, contrat, loi, appel, témoin, plainte, clause, avocat, juge
es: tribunal, juicio, sentencia, contrato, ley, recurso, testigo, querella, cláusula, abogado, juez
it: tribunale, processo, sentenza, contratto, legge, ricorso, testimone, querela, clausola, avvocato, giudice
pt: tribunal, julgamento, sentença, contrato, lei, recurso, testemunha, queixa, cláusula, advogado, juiz
nl: rechtbank, proces, vonnis, contract, wet, beroep, getuige, aanklacht, clausule, advocaat, rechter
pl: sąd, proces, wyrok, umowa, ustawa, apelacja, świadek, pozew, klauzula, adwokat, sędzia
ru: суд, иск, приговор, договор, закон, апелляция, свидетель, заседание, адвокат, судья
ja: 裁判所, 判決, 契約, 法律, 控訴, 証人, 訴状, 契約条項, 弁護士, 条例""",
    "sport": """
en: match, goalkeeper, stadium, championship, referee, league, marathon, training camp, penalty kick, halftime, defender, team, tournament, relay
de: mannschaft, stadion, meisterschaft, schiedsrichter, tabelle, halbzeit, endspiel, trainingslager, torwart, turnier, pokal
fr: équipe, stade, championnat, arbitre, classement, mi temps, finale, entraîneur, gardien, tournoi
es: equipo, estadio, campeonato, árbitro, clasificación, descanso, final, entrenador, portero, torneo
it: squadra, stadio, campionato, arbitro, classifica, intervallo, finale, allenatore, portiere, torneo
pt: equipa, estádio, campeonato, árbitro, classificação, intervalo, final, treinador, torneio
nl: ploeg, stadion, kampioenschap, scheidsrechter, ranglijst, rust, finale, trainer, keeper, toernooi
pl: drużyna, stadion, mistrzostwa, sędzia liniowy, tabela, przerwa, finał, trener, bramkarz, turniej, zgrupowanie
ru: команда, стадион, чемпионат, судья матча, тренер, финал, вратарь, турнир, сборы
ja: 選手権, 競技場, 審判, 順位表, 前半戦, 決勝, 監督, 得点, 試合, 合宿""",
    "software": """
en: compiler, database, memory leak, interface, unit test, regression, config file, release branch, api, endpoint, software, programming, cache, thread pool, plugin, debugger
de: programm, datenbank, speicherleck, schnittstelle, modultest, bibliothek, konfigurationsdatei, fehlermeldung, compiler, software
fr: programme, base de données, fuite de mémoire, interface, test unitaire, bibliothèque, fichier de configuration, message d erreur, logiciel, compilateur
es: programa, base de datos, fuga de memoria, interfaz, prueba unitaria, biblioteca, archivo de configuración, mensaje de error, compilador
it: programma, base di dati, perdita di memoria, interfaccia, test unitario, libreria, file di configurazione, messaggio di errore, modulo, compilatore
pt: programa, base de dados, fuga de memória, interface, teste unitário, biblioteca, ficheiro de configuração, mensagem de erro, módulo, compilador
nl: programma, databank, geheugenlek, interface, eenheidstest, bibliotheek, instellingenbestand, foutmelding, compiler
pl: program, baza danych, wyciek pamięci, interfejs, test jednostkowy, biblioteka, plik konfiguracyjny, komunikat o błędzie, moduł, kompilator
ru: программа, база данных, утечка памяти, интерфейс, модульный тест, библиотека, файл настроек, сообщение об ошибке, модуль, компилятор
ja: プログラム, データベース, インターフェース, 単体テスト, ライブラリ, 設定ファイル, エラー表示, メモリ管理, モジュール""",
    "health": """
en: patient, clinic, vaccine, prescription, surgery, blood pressure, physiotherapy, symptom, inflammation, allergy, nurse, therapy, check up, immune response, diagnosis
de: patient, klinik, impfung, impfstoff, rezept vom arzt, operation, blutdruck, therapie, entzündung, untersuchung, medikament, arzt
fr: patient, clinique, vaccin, ordonnance, opération, tension artérielle, thérapie, inflammation, consultation, médicament, médecin
es: paciente, clínica, vacuna, receta médica, operación, presión arterial, terapia, inflamación, revisión, medicamento, médico, rodilla
it: paziente, clinica, vaccino, ricetta medica, operazione, pressione, terapia, infiammazione, visita, farmaco, medico
pt: paciente, clínica, vacina, receita médica, operação, tensão arterial, terapia, inflamação, consulta, medicamento, médico
nl: patiënt, kliniek, vaccin, recept van de arts, operatie, bloeddruk, therapie, ontsteking, onderzoek, medicijn, arts
pl: pacjent, klinika, szczepionka, recepta, operacja, ciśnienie krwi, terapia, zapalenie, badanie, lek, lekarz
ru: пациент, клиника, прививка, вакцина, рецепт врача, операция, давление, терапия, воспаление, осмотр, лекарство, врач
ja: 患者, 診療所, 予防接種, 処方箋, 手術, 血圧, 治療, 炎症, 健康診断, 医師""",
    "finance": """
en: mortgage, loan, dividend, shareholder, inflation, interest rate, savings account, pension fund, bond, audit, tax return, exchange rate, portfolio, balance sheet, cash flow, hedge
de: hypothek, kredit, dividende, anleihe, rendite, bilanz, sparkonto, steuererklärung, portfolio, zinssatz, aktie
fr: hypothèque, emprunt, dividende, obligation, rendement, bilan, livret d épargne, impôt, portefeuille, taux d intérêt, action
es: hipoteca, préstamo, dividendo, bono, rendimiento, balance, cuenta de ahorro, declaración fiscal, cartera, tipo de interés
it: ipoteca, prestito, dividendo, obbligazione, rendimento, bilancio, conto di risparmio, dichiarazione dei redditi, portafoglio
pt: hipoteca, empréstimo, dividendo, obrigação, rendimento, balanço, conta poupança, declaração fiscal, carteira
nl: hypotheek, lening, dividend, obligatie, rendement, balans, spaarrekening, belastingaangifte, portefeuille
pl: hipoteka, pożyczka, dywidenda, obligacja, stopa zwrotu, bilans, konto oszczędnościowe, zeznanie podatkowe, portfel
ru: ипотека, заём, дивиденд, облигация, доходность, баланс, сберегательный счёт, налоговая декларация, портфель
ja: 住宅ローン, 配当金, 債券, 利回り, 貸借対照表, 預金口座, 確定申告, 運用資産, 融資""",
    "cooking": """
en: broth, garlic, sourdough, spice mix, cutting board, marinade, butter, pastry dough, oven, stew, sauce, flour, bread, roasted pepper, dumpling
de: gewürz, pfanne, suppe, brühe, gemüse, teig, butter, brot, soße, kochen, backofen
fr: épice, poêle, soupe, bouillon, légume, pâte, beurre, pain, sauce, four
es: especia, sartén, sopa, caldo, verdura, masa, mantequilla, pan, salsa, horno
it: spezia, padella, zuppa, brodo, verdura, impasto, burro, pane, sugo, forno
pt: especiaria, frigideira, sopa, caldo, legume, massa, manteiga, pão, molho, forno
nl: kruiden, pan, soep, bouillon, groente, deeg, boter, brood, saus, oven
pl: przyprawa, patelnia, zupa, bulion, warzywo, ciasto, masło, chleb, sos, piekarnik
ru: приправа, сковорода, суп, бульон, овощ, тесто, масло, хлеб, соус, духовка
ja: 香辛料, フライパン, 味噌汁, 出汁, 根菜, 生地, バター, 食パン, 煮込み""",
    "travel": """
en: hostel, ferry, itinerary, luggage, boarding pass, guidebook, campsite, night train, border crossing, visa, mountain pass, cable car, hiking, viewpoint, coastal path, harbour
de: hotelzimmer, fähre, reise, gepäck, reisebüro, visum, grenze, küste, wanderhütte, herberge, koffer
fr: auberge, ferry, voyage, valise, agence, visa, frontière, côte, refuge, bagage
es: albergue, transbordador, viaje, maleta, agencia, visado, frontera, costa, refugio, equipaje
it: ostello, traghetto, viaggio, valigia, agenzia, visto, frontiera, costa, rifugio, bagaglio
pt: albergue, balsa, viagem, mala, agência, visto, fronteira, costa, abrigo, bagagem
nl: herberg, veerboot, reis, koffer, reisbureau, visum, grens, kust, berghut, bagage
pl: schronisko, prom, podróż, walizka, biuro podróży, wiza, granica, wybrzeże, bagaż
ru: гостиница, паром, поездка, чемодан, турагентство, виза, граница, побережье, приют, багаж
ja: 山小屋, 旅行, 旅行鞄, 査証, 国境, 海岸, 旅館, 案内所, 荷物""",
}
